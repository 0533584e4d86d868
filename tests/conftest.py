import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tests.oracle_check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture(scope="session")
def panel_rows(spark):
    """A small two-key panel with gaps, ties and unequal lengths."""
    import datetime as dt
    import random

    rng = random.Random(7)
    rows = []
    for key, n in (("a", 240), ("b", 37)):
        for i in range(n):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i + (5 if i > 20 else 0))
            x = None if rng.random() < 0.08 else round(rng.choice([0.0, 0.0, rng.gauss(5, 3)]), 1)
            rows.append((key, day, x, round(rng.gauss(0, 1), 3)))
    return spark.createDataFrame(rows, "site string, day date, x double, y double")
