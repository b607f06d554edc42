"""All queries over the driver's tables, by name."""

from fieldglass.plans import deeper, mining, relational, tabular

ALL_QUERIES: dict = {}
ALL_ORACLES: dict = {}
for _part in (tabular, relational, mining, deeper):
    ALL_QUERIES |= _part.R.queries
    ALL_ORACLES |= _part.R.oracles
