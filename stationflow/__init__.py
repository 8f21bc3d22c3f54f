"""stationflow: station-occupancy analytics on Spark DataFrames.

Layout: ``functions`` (column expressions), ``sources`` (readers and sinks),
``operators`` (joins, aggregates, planner), ``streaming`` (incremental state),
``plans`` (query registry over the driver's tables).
"""

__version__ = "0.1.0"
