"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import math

import pandas as pd
import pytest

from duelframe.plans.registry import ORACLES, QUERIES

from .conftest import SF


def plain(value):
    if value is None or pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if isinstance(value, (bool, int, float)) or hasattr(value, "dtype"):
        return round(float(value), 6) + 0.0
    return str(value)[:19].removesuffix(" 00:00:00")


def rows(df):
    cols = sorted(df.columns)
    return sorted(([plain(v) for v in r] for r in df[cols].itertuples(index=False)), key=repr)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b) for x, y in zip(r, s))
