"""Student-t tail probability as a Column expression (no Python worker, no numeric library)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.scalar import c

#: Panels of the quadrature, in units of the integrand's own width, and Gauss-Legendre nodes per panel.
PANELS = ((0.0, 2.0), (2.0, 5.0), (5.0, 10.0), (10.0, 20.0), (20.0, 40.0))
NODES = 20


def _adder(mid: Column, half: Column, v: Column) -> Callable[[Column, Column], Column]:
    def add(total: Column, node: Column) -> Column:
        s = F.sin((mid + half * node["x"]) / F.sqrt(v) / 2)
        # the log of the cosine, 1 - 2 s^2, without cancellation near 0
        return total + F.exp((v - 1) * F.log1p(F.greatest(s * s * -2, F.lit(-1 + 1e-16)))) * node["w"]

    return add


def _area(start: Column, end: Column, v: Column) -> Column:
    """Integral of cos(u / sqrt(v))^(v-1) from start to end (or 40 units on, where nothing is left)."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip(x, w, strict=True)))
    total = F.lit(0.0)
    for a, b in PANELS:
        lo, hi = F.least(start + a, end), F.least(start + b, end)
        half, mid = (hi - lo) / 2, (hi + lo) / 2
        total = total + half * F.aggregate(nodes, F.lit(0.0), _adder(mid, half, v))
    return total


def t_two_sided_p(t, df) -> Column:
    """P(|T_df| >= |t|) for any df of at least 1; NULL below.

    With tan(phi) = t / sqrt(df) the density is proportional to cos(phi)^(df-1), so p is the area beyond phi over the
    whole area up to a right angle. In u = phi * sqrt(df) the integrand is close to a Gaussian of unit width for every
    df, and a fixed number of nodes integrates both areas: the work does not depend on df.
    """
    v = F.when(c(df) >= 1, c(df).cast("double"))
    at = F.atan(F.abs(c(t)) / F.sqrt(v)) * F.sqrt(v)
    end = F.sqrt(v) * (math.pi / 2)
    whole = _area(F.lit(0.0), end, v)
    return F.least(F.greatest(_area(at, end, v) / whole, F.lit(0.0)), F.lit(1.0))
