"""Scalar column expressions.

Every function returns a ``Column`` built from JVM-side functions, so all of
them stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values that must equal the reference for right results.
# Colour of a balanced station, the drop-off divisor, the target fill levels before
# and after a visit, and the colour threshold.
BALANCED_COLOR = "#00FF00"
DROPOFF_DIVISOR = 1.7
INITIAL_TARGET = 0.45
VISITED_TARGET = 0.5
COLOR_THRESHOLD = 0.1
# 0001-01-01 and the last second of 9999.
MIN_EPOCH, MAX_EPOCH = -62_135_596_800, 253_402_300_799
# Mean Earth radius in metres (the reference names none; kept as a parameter).
EARTH_RADIUS_M = 6371008.8


def as_column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- B1-B3: JSON access and casts -----------------------------------------------------


def json_text_field(text: ColumnOrName, path: str) -> Column:
    """Path access on a JSON *text* column; a missing key gives NULL (B1)."""
    return F.get_json_object(as_column(text), path)


def to_number(c: ColumnOrName) -> Column:
    """``::number``: a scale-0 number (half-up), NULL when the text is not numeric (B2)."""
    return as_column(c).try_cast("decimal(38,0)").try_cast("bigint")


def to_number_scaled(c: ColumnOrName, precision: int, scale: int) -> Column:
    """``::number`` into a NUMBER(p,s) column: round to a whole number first, then widen."""
    return as_column(c).try_cast("decimal(38,0)").try_cast(f"decimal({precision},{scale})")


def to_boolean(c: ColumnOrName) -> Column:
    return as_column(c).try_cast("boolean")


def to_fixed(c: ColumnOrName, precision: int = 12, scale: int = 7) -> Column:
    """``to_numeric(text, p, s)``: fixed-point parse straight from text."""
    return as_column(c).cast("string").try_cast(f"decimal({precision},{scale})")


# --- B4-B7: stamps, ratio, docks ------------------------------------------------------


def ingest_stamp() -> Column:
    """Load/refresh stamp TST_REC: session-zone wall time without zone."""
    return F.localtimestamp()


def epoch_to_ntz(seconds: ColumnOrName) -> Column:
    """Epoch seconds -> UTC wall time as TIMESTAMP_NTZ, independent of the session zone.

    Seconds outside the years 1 to 9999 give NULL, so one bad report can't fail a batch.
    """
    s = as_column(seconds)
    stamp = F.timestamp_add("SECOND", s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(s.between(MIN_EPOCH, MAX_EPOCH), stamp)


def occupation_ratio(bikes: ColumnOrName, capacity: ColumnOrName) -> Column:
    """Exact decimal quotient, 6 decimals then stored as NUMBER(12,4), half-up.

    Zero capacity and a quotient that NUMBER(12,4) can't hold give NULL instead of failing the batch.
    """
    q = F.try_divide(as_column(bikes).cast("decimal(19,0)"), as_column(capacity).cast("decimal(19,0)"))
    return F.round(q, 6).try_cast("decimal(12,4)")


def usable_docks(bikes: ColumnOrName, docks: ColumnOrName) -> Column:
    return as_column(bikes) + as_column(docks)


def broken_docks(capacity: ColumnOrName, bikes: ColumnOrName, docks: ColumnOrName) -> Column:
    """capacity - (bikes + docks), NULL-propagating."""
    return as_column(capacity) - usable_docks(bikes, docks)


# --- B10-B14: balance arithmetic -------------------------------------------------------


def finite(c: Column) -> Column:
    """NaN -> NULL so aggregates skip it the way pandas does."""
    return F.nanvl(c, F.lit(None).cast("double"))


def binary_entropy(ratio: ColumnOrName) -> Column:
    """0 at r in {0,1}; -r log2 r - (1-r) log2(1-r) inside; NULL outside [0,1]."""
    r = as_column(ratio).cast("double")
    inner = -r * F.log2(r) - (F.lit(1.0) - r) * F.log2(F.lit(1.0) - r)
    return F.when(r.isin(0.0, 1.0), F.lit(0.0)).when((r > 0.0) & (r < 1.0), inner)


def occupancy_color(ratio: ColumnOrName, threshold: float = COLOR_THRESHOLD) -> Column:
    """Hex colour of a fill ratio.

    Inside [0.5-t, 0.5+t] green; below blends green->blue, above green->red. Channels
    are truncated toward zero and clamped to 0..255; NULL/NaN ratio gives NULL.
    """
    if not 0.0 < threshold < 0.5:
        raise ValueError("threshold must lie strictly between 0 and 0.5")
    lo = 0.5 - threshold
    hi = 0.5 + threshold
    r = finite(as_column(ratio).cast("double"))

    def chan(x: Column) -> Column:
        return F.least(F.greatest(x.cast("int"), F.lit(0)), F.lit(255))

    below = F.format_string(
        "#%02x%02x%02x", F.lit(0), chan(F.lit(255.0) * r / lo), chan(F.lit(255.0) * (F.lit(lo) - r) / lo)
    )
    above = F.format_string(
        "#%02x%02x%02x",
        chan(F.lit(255.0) * (r - F.lit(hi)) / lo),
        chan(F.lit(255.0) * (F.lit(1.0) - (r - F.lit(hi)) / lo)),
        F.lit(0),
    )
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when((r >= lo) & (r <= hi), F.lit(BALANCED_COLOR))
        .when(r < lo, below)
        .otherwise(above)
    )


def bike_need(capacity: ColumnOrName, bikes: ColumnOrName, target: float = INITIAL_TARGET) -> Column:
    """round(capacity * target - bikes), half-to-even."""
    return F.rint(as_column(capacity).cast("double") * F.lit(float(target)) - as_column(bikes).cast("double"))


def pickup_amount(free_space: ColumnOrName, need: ColumnOrName, bikes: ColumnOrName) -> Column:
    """min(min(free truck space, |need|), bikes at the station)."""
    free = as_column(free_space).cast("double")
    return F.least(F.least(free, F.abs(as_column(need).cast("double"))), as_column(bikes).cast("double"))


def dropoff_amount(load: ColumnOrName, need: ColumnOrName, docks: ColumnOrName) -> Column:
    """round(min(load, need, free docks) / 1.7), half-to-even."""
    m = F.least(as_column(load).cast("double"), as_column(need).cast("double"), as_column(docks).cast("double"))
    return F.rint(m / F.lit(DROPOFF_DIVISOR))


# --- B15-B16: distances -----------------------------------------------------------------


def geo_distance_m(
    lon1: ColumnOrName,
    lat1: ColumnOrName,
    lon2: ColumnOrName,
    lat2: ColumnOrName,
    radius_m: float = EARTH_RADIUS_M,
) -> Column:
    """Great-circle distance in metres (haversine) between two lon/lat points."""
    p1 = F.radians(as_column(lat1).cast("double"))
    p2 = F.radians(as_column(lat2).cast("double"))
    dp = p2 - p1
    dl = F.radians(as_column(lon2).cast("double")) - F.radians(as_column(lon1).cast("double"))
    s1 = F.sin(dp / 2.0)
    s2 = F.sin(dl / 2.0)
    h = s1 * s1 + F.cos(p1) * F.cos(p2) * s2 * s2
    return F.lit(2.0 * radius_m) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def degree_distance(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName) -> Column:
    """Plain Euclidean distance in degrees, no cos(lat) correction."""
    dlat = as_column(lat1).cast("double") - as_column(lat2).cast("double")
    dlon = as_column(lon1).cast("double") - as_column(lon2).cast("double")
    return F.sqrt(dlat * dlat + dlon * dlon)


# --- B17-B19: text and visited ratio --------------------------------------------------
# The output sentences below must read as the reference's do.


def refresh_message(n: ColumnOrName) -> Column:
    """'Processed N rows' (B17)."""
    return F.concat(F.lit("Processed "), as_column(n).cast("string"), F.lit(" rows"))


def action_text(action_kind: ColumnOrName, amount: ColumnOrName) -> Column:
    """'Picked up N bikes' / 'Dropped off N bikes' (B17)."""
    verb = F.when(as_column(action_kind) == "pickup", F.lit("Picked up ")).otherwise(F.lit("Dropped off "))
    return F.concat(verb, as_column(amount).cast("string"), F.lit(" bikes"))


def leg_text(action: ColumnOrName, from_id: ColumnOrName, to_id: ColumnOrName) -> Column:
    """'Bus <action>, then moved from Station <a> to Station <b>.' (B17)."""
    return F.concat(
        F.lit("Bus "),
        as_column(action),
        F.lit(", then moved from Station "),
        as_column(from_id).cast("string"),
        F.lit(" to Station "),
        as_column(to_id).cast("string"),
        F.lit("."),
    )


def station_label(label: ColumnOrName, bikes: ColumnOrName) -> Column:
    """'Station ID: <label> - Bikes Available: <n>' (B18); a missing value prints None."""
    return F.concat(
        F.lit("Station ID: "),
        F.coalesce(as_column(label).cast("string"), F.lit("None")),
        F.lit(" - Bikes Available: "),
        F.coalesce(as_column(bikes).cast("string"), F.lit("None")),
    )


def visited_ratio(bikes: ColumnOrName, total_capacity: ColumnOrName) -> Column:
    """Raw float ratio bikes / TOTAL_CAPACITY; zero capacity gives NULL."""
    return F.try_divide(as_column(bikes).cast("double"), as_column(total_capacity).cast("double"))
