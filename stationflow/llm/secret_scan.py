"""Secrets by a trigram inverted index.

From each rule's regex follows a Boolean query of trigrams: each way through the
regex (its branches and optional parts) is an AND of the trigrams of its fixed
letters, and the ways are joined by OR. The index holds postings (trigram,
document) of the rules' trigrams, taken from lower-cased texts. Postings are
intersected by counting off each AND's trigrams per document; what is left are
candidates, and their texts are verified with the regex itself. A rule with a
way that has no trigram scans every text.

Texts of documents that can't be candidates never leave their scan: a bitmap of
fixed size over hashed candidates says, without a miss, whose text is sent on.
Everything is built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.session import cut_lineage

#: Most ways through a regex that are told apart; beyond, the rule scans all texts.
MAX_WAYS = 256
#: Bits of the candidate bitmap: 4 MB however many documents there are.
BITMAP_BITS = 1 << 25
#: Matches of a text whose places are summed in one go.
AT_ONCE = 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose group ``group`` has ``least`` characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base kinds; their order is the order of ties. Patterns hold in Java, RE2 and Python alike.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),  # AKIA[A-Z0-9]+ of 16 characters or more: a run's first match is its longest
    Rule("hex", r"[0-9a-f]{32,}"),  # [0-9a-f]+ of 32 or more
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
)
BASE_KINDS = ("assign", "access", "hex")

GAP = "\x00"  # something that isn't a fixed letter


def _ways(parsed: Sequence) -> list[str]:
    """The ways through a parsed regex as strings of fixed letters and gaps."""
    ways = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(value).lower()]
        elif name == "SUBPATTERN":
            own = _ways(value[3])
        elif name == "BRANCH":
            own = [w for branch in value[1] for w in _ways(branch)]
        elif name == "IN" and len(value) <= 8 and all(str(o) == "LITERAL" for o, _ in value):
            own = sorted({chr(v).lower() for _, v in value})
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            once = _ways(inner)
            if GAP in "".join(once):
                own = [GAP]
            elif (least, most) == (0, 1):
                own = ["", *once]
            else:
                own = [w * min(least, 3) + GAP for w in once] if least and len(once) == 1 else [GAP]
        elif name == "AT":
            own = [""]
        else:
            own = [GAP]
        ways = [a + b for a in ways for b in own]
        if len(ways) > MAX_WAYS:
            return [GAP]
    return ways


def trigram_query(pattern: str) -> list[list[str]] | None:
    """An OR of ANDs of lower-case trigrams that every match holds; None where a match may hold none."""
    clauses = set()
    for way in _ways(re._parser.parse(pattern)):
        runs = way.split(GAP)
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2) if r[i : i + 3].isascii())
        if not grams:
            return None
        clauses.add(frozenset(sorted(grams)[:63]))
    return sorted(sorted(c) for c in clauses if not any(other < c for other in clauses))


def postings(rows: DataFrame, grams: Sequence[str]) -> DataFrame:
    """The inverted index (gram, row) of the given trigrams over ``rows`` (row, text)."""
    lowered = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(g)), F.lit(g)) for g in grams]))
    return rows.select("row", F.explode(held).alias("gram"))


def candidates(rows: DataFrame, queries: dict[int, list[list[str]]]) -> DataFrame:
    """(row, rules): documents whose postings satisfy the queries of the rules numbered so."""
    spark = rows.sparkSession
    terms = [
        (gram, rule, clause, 1 << i, (1 << len(grams)) - 1)
        for rule, clauses in queries.items()
        for clause, grams in enumerate(clauses)
        for i, gram in enumerate(grams)
    ]
    clauses = spark.createDataFrame(terms, "gram string, rule int, clause int, bit long, all_bits long")
    index = postings(rows, sorted({t[0] for t in terms}))
    # The clauses are as many as the rules' trigrams, whatever the corpus.
    met = index.join(F.broadcast(clauses), "gram").groupBy("row", "rule", "clause", "all_bits").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = all_bits").groupBy("row").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def _bitmap(found: DataFrame) -> DataFrame:
    """Bits at the hashes of candidate rows, in buckets of 4 KB, at most BITMAP_BITS in all."""
    at = F.pmod("row", F.lit(BITMAP_BITS))
    return found.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def spans(text: Column, number: int, rule: Rule) -> Column:
    """The rule's spans in ``text``: array of (start, kind number, end), in code points.

    Where the matches lie follows from the lengths of the matches and of what lies between
    them. They are summed in blocks of ``AT_ONCE`` matches and the blocks put together, as
    a list that grows match by match is copied each time.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(
        F.transform(between, lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("size"),
        F.transform(judged, lambda x: F.length(x)).alias("judged"),
    )
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        # what lies behind the last match has no size, and so is no match
        found = F.when(F.coalesce(x["judged"] >= rule.least, F.lit(False)), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def shift(acc: Column, x: Column) -> Column:
        moved = F.transform(x["found"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / AT_ONCE).cast("int")), lambda k: F.slice(steps, k * AT_ONCE + 1, AT_ONCE))
    summed = F.transform(blocks, lambda b: F.aggregate(b, start, step))
    whole_text = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start: int, kind: int, end: int>>>)").alias("found"))
    return F.when(F.rlike(text, F.lit(rule.pattern)), F.aggregate(summed, whole_text, shift, lambda acc: F.flatten(acc["found"]))).otherwise(none)


def with_spans(docs: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule] = RULES, keep: Sequence[str] | None = None) -> DataFrame:
    """(of, spans): the columns ``keep`` (all, unless given) as a struct, so that no name
    can clash, and all rules' spans by start, then by the rules' order.

    Only candidates' texts are shuffled if ``keep`` leaves the text out. NULL texts have no spans.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    name = lambda c: F.col(f"`{c}`")
    text = F.coalesce(name(text_col), F.lit(""))
    # Rows that are alike share a number; should others ever do, they are just verified both.
    row = F.xxhash64(name(id_col), name(text_col)).alias("row")
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    full = [spans(text, i, r) for i, r in enumerate(rules) if i not in queries]
    rows = docs.select(F.struct(*map(name, keep or docs.columns)).alias("of"), row, text.alias("text"), F.concat(none, *full).alias("spans"))
    if queries:
        found = cut_lineage(candidates(docs.select(row, text.alias("text")), queries), "candidates")
        at = F.pmod("row", F.lit(BITMAP_BITS))
        position = F.bitmap_bit_position(at)
        rows = rows.join(F.broadcast(_bitmap(found)), F.bitmap_bucket_number(at) == F.col("bucket"), "left")
        byte = F.conv(F.hex(F.substring(F.col("bits"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        maybe = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0, F.lit(False))
        rows = rows.select("of", "row", "spans", F.when(maybe, F.col("text")).alias("text")).join(found, "row", "left")
        verified = [F.when(F.array_contains("rules", i), spans(F.col("text"), i, rules[i])) for i in queries]
        rows = rows.select("of", F.concat("spans", *[F.coalesce(v, none) for v in verified]).alias("spans"))
    return rows.select("of", F.array_sort("spans").alias("spans"))


def _listed(of: Column, rules: Sequence[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    said = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(of, said), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``.

    Spans are written kind:start:end in code points (end exclusive), comma-joined.
    NULL and empty texts have none (the digest of the empty text); ids aren't
    used but to be returned, and may be NULL. Repeated rows stay; an empty table
    gives no rows; other columns are left out. A very long text is matched whole, in time linear
    in its matches.
    """
    found = with_spans(docs, id_col, text_col, rules, [id_col])
    base = [i for i, r in enumerate(rules) if r.kind in BASE_KINDS]
    of_kind = lambda i: F.filter("spans", lambda s: s["kind"] == i)
    counts = {f"n_{rules[i].kind}": F.size(of_kind(i)).cast("long") for i in base}
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col("of")[id_col].alias(id_col),
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(_listed(of_base, rules), 256).alias("base_sha256"),
        _listed(F.col("spans"), rules).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, mask: str = "<SECRET>", length_col: str | None = None) -> DataFrame:
    """``docs`` with ``mask`` in place of each run of overlapping spans; every document and column stays.

    Texts without secrets, NULL ones too, stay as they are. ``length_col`` names a
    column that is set to the new length where a text has changed.
    """
    found = with_spans(docs, id_col, text_col, rules)
    text = F.col("of")[text_col]

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["made"], piece)).otherwise(acc["made"]).alias("made"))

    rest = lambda acc: F.concat(acc["made"], F.substring(text, acc["at"] + 1, F.length(text)))
    made = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("made")), step, rest)
    found = found.select("of", F.when(F.size("spans") > 0, made).alias("made"))
    new = {text_col: F.coalesce("made", text)}
    if length_col:
        new[length_col] = F.coalesce(F.length("made"), F.col("of")[length_col]).cast(docs.schema[length_col].dataType)
    return found.select(*[new.get(c, F.col("of")[c]).alias(c) for c in docs.columns])


def oracle_sql(table: str = "documents", rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for ``scan``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    columns, lists = [], []
    for i, r in enumerate(rules):
        p = quoted(r.pattern)
        columns.append(
            f"list_transform(regexp_extract_all(t, {p}, 0), lambda x: length(x)) AS size{i}, "
            f"list_transform(regexp_extract_all(t, {p}, {r.group}), lambda x: length(x)) AS judged{i}, "
            f"list_transform(string_split_regex(t, {p}), lambda x: length(x)) AS gap{i}"
        )
        start = f"(list_sum(gap{i}[1:i]) + coalesce(list_sum(size{i}[1:i-1]), 0))::BIGINT"
        lists.append(f"[{{'s': {start}, 'k': {i}, 'e': ({start} + size{i}[i])::BIGINT}} for i in range(1, len(size{i}) + 1) if judged{i}[i] >= {r.least}]")
    names = "[" + ", ".join(quoted(r.kind) for r in rules) + "]"
    said = f"{names}[x.k + 1] || ':' || x.s || ':' || x.e"
    base = [i for i, r in enumerate(rules) if r.kind in BASE_KINDS]
    in_base = "(" + ", ".join(map(str, base)) + ")"
    counts = ", ".join(f"len(list_filter(found, lambda x: x.k = {i}))::BIGINT AS n_{rules[i].kind}" for i in base)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
parts AS (SELECT doc_id, {", ".join(columns)} FROM texts),
spans AS (SELECT doc_id, list_sort({" || ".join(lists)}) AS found FROM parts)
SELECT doc_id, {counts},
  sha256(coalesce(array_to_string(list_transform(list_filter(found, lambda x: x.k IN {in_base}), lambda x: {said}), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(found, lambda x: {said}), ','), '') AS spans
FROM spans"""
