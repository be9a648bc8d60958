"""Queries over the driver's tables and their DuckDB twins, by name."""

from . import metadata, signals, timeseries, units

QUERIES: dict = {**timeseries.QUERIES, **metadata.QUERIES, **signals.QUERIES, **units.QUERIES}
ORACLES: dict = {**timeseries.ORACLES, **metadata.ORACLES, **signals.ORACLES, **units.ORACLES}
