"""Registry of the named queries and shared SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return register


# The panel of ``pluvia.sources.panel`` in SQL; queries append CTEs after it.
PANEL = """
WITH obs AS (
  SELECT s_nationkey AS site, CAST(l_shipdate AS DATE) AS day,
         ROUND(SUM(l_quantity * l_discount * 10), 4) AS rain,
         ROUND(AVG(l_quantity), 6) AS temp, ROUND(AVG(l_tax * 100), 6) AS humidity,
         ROUND(AVG(l_extendedprice), 6) AS pressure, ROUND(AVG(l_discount * 100), 6) AS wind,
         COUNT(*) AS n_obs
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
sites AS (SELECT DISTINCT site FROM obs),
days AS (SELECT CAST(UNNEST(GENERATE_SERIES(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
panel AS (
  SELECT s.site, d.day, COALESCE(o.rain, 0) AS rain, o.temp, o.humidity, o.pressure, o.wind,
         COALESCE(o.n_obs, 0) AS n_obs
  FROM sites s CROSS JOIN days d LEFT JOIN obs o ON o.site = s.site AND o.day = d.day)
"""

# The single series of all sites together.
TOTAL = PANEL + ", total AS (SELECT day, ROUND(SUM(rain), 4) AS rain FROM panel GROUP BY day)"

# The raw lineitem measures in long form.
RAW = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = "WITH long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in RAW
) + ")"


def rounded(df, digits: int, *columns: str):
    """Round the named columns, so float noise does not decide a comparison."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) for c in columns})
