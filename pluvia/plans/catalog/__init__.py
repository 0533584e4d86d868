"""Named queries over the star-schema tables and the same queries in SQL.

Each module registers functions (spark, sf_dir) -> DataFrame; where standard
SQL can say the same over whole tables, the SQL stands next to the query.
"""

from pluvia.plans.catalog import (  # noqa: F401  (imports fill the registry)
    correlations,
    features,
    models,
    profiles,
    runners,
    series_tests,
    sources,
)
from pluvia.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
