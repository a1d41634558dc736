"""Named query plans over the driver's tables, each with the SQL it must agree with."""

from sediment.plans import archives, catalog, layout, names, scalar, snapshot

QUERIES: dict = {}
ORACLES: dict = {}
for module in (catalog, snapshot, layout, scalar, names, archives):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
