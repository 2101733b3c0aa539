"""Tail of Student's t distribution, for tables of one row per tested variable."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these functions with the query, without the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Nodes and weights of the double-exponential rule for integrals from 0 to infinity: u = exp(pi/2 sinh s).
_STEP = 1 / 64
_S = np.arange(-4.5, 4.5 + _STEP, _STEP)
_NODES = np.exp(math.pi / 2 * np.sinh(_S))
_WEIGHTS = _STEP * math.pi / 2 * np.cosh(_S) * _NODES


def two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|): the density's integral beyond ``|t|``, by one rule for all degrees of freedom."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    start = abs(t)
    # The integral is taken in units of the tail's own width, so that nodes lie where the density falls.
    width = math.sqrt(1 + start * start / df) / math.sqrt(1 + start * start)
    with np.errstate(over="ignore"):
        u = start + width * _NODES
        density = np.exp(_log_scale(df) - (df + 1) / 2 * np.log1p(u * (u / df)))
    return min(1.0, 2 * width * float((_WEIGHTS * density).sum()))


def quantile(p: float, df: float) -> float:
    """Value the t variable stays below with probability ``p`` (0.5 <= p < 1)."""
    if df is None or math.isnan(df) or df <= 0:
        return float("nan")
    tail = 2 * (1 - p)
    low, high = 0.0, 1.0
    while two_sided_p(high, df) > tail:
        high *= 2
    # Ends when no number lies between the two.
    while (middle := (low + high) / 2) not in (low, high):
        if two_sided_p(middle, df) > tail:
            low = middle
        else:
            high = middle
    return middle


def _log_scale(df: float) -> float:
    """Log of the density at 0. The two gamma terms are subtracted as series, so that large ones do not cancel."""
    x, shifted = df / 2, 0.0
    while x < 15:
        shifted += math.log1p(0.5 / x)
        x += 1

    def rest(z: float) -> float:
        return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z

    ratio = x * math.log1p(0.5 / x) + 0.5 * math.log(x) - 0.5 + rest(x + 0.5) - rest(x) - shifted
    return ratio - 0.5 * math.log(df * math.pi)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([quantile(a, b) for a, b in zip(p, df)], dtype="float64")
