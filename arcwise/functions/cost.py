"""Link performance as Column expressions, and the same formulas on NumPy arrays for the kernels.

x flow, c capacity, t0 free-flow time. Families: linear (beta 1), quartic (beta 4), general, conic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def family(beta: Column) -> Column:
    return F.when(beta == 1, F.lit("linear")).when(beta == 4, F.lit("quartic")).otherwise(F.lit("general"))


def _args(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in ("capacity", "free_flow_time", "alpha", "beta")]


def time_cost(x: Column, prefix: str = "") -> Column:
    """Travel time at flow x, without fixed cost. Quartic is four products (no pow); general has time t0 for x <= 0."""
    c, t0, a, b = _args(prefix)
    y = x / c
    return (
        F.when(b == 1, t0 * (1 + a * y))
        .when(b == 4, t0 * (1 + a * (y * y * y * y)))
        .otherwise(F.when(x <= 0, t0).otherwise(t0 * (1 + a * F.pow(y, b))))
    )


def derivative(x: Column, prefix: str = "") -> Column:
    c, t0, a, b = _args(prefix)
    y = x / c
    return (
        F.when(b == 1, t0 * a / c)
        .when(b == 4, 4 * t0 * a * (y * y * y) / c)
        .otherwise(F.when(x <= 0, F.lit(0.0)).otherwise(t0 * a * b / c * F.pow(y, b - 1)))
    )


def integral(x: Column, prefix: str = "") -> Column:
    """Area under the time curve from 0 to x (fixed costs are added by class in the objective)."""
    c, t0, a, b = _args(prefix)
    y = x / c
    return (
        F.when(b == 1, x * t0 * (1 + a * y / 2))
        .when(b == 4, x * t0 * (1 + a * (y * y * y * y) / 5))
        .otherwise(F.when(x <= 0, F.lit(0.0)).otherwise(x * t0 * (1 + a / (b + 1) * F.pow(y, b))))
    )


#: Parameters of a conical link besides capacity and free-flow time.
CONIC = ("a", "b", "e", "h0", "sat", "s", "ca", "cb", "cc", "cd", "m", "u")


def _conic(x: Column, p: dict[str, Column]) -> tuple[Column, Column, Column]:
    gap = 1 - x / F.col("capacity") + p["e"]
    return gap, F.sqrt(p["b"] * p["b"] + p["a"] * p["a"] * gap * gap), x / p["sat"]


def conic_cost(x: Column, p: dict[str, Column]) -> Column:
    """Conical delay plus signal delay (three pieces in volume over saturation flow) plus unsignalised delay."""
    gap, root, vs = _conic(x, p)
    signal = (
        F.when(vs <= 0.875, p["s"] / (1 - vs))
        .when(vs < 0.925, p["cd"] + vs * (p["cc"] + vs * (p["cb"] + vs * p["ca"])))
        .otherwise(p["s"] / 0.1)
    )
    t0 = F.col("free_flow_time")
    return t0 + t0 * (1 + root - p["a"] * gap - p["b"] - p["h0"]) + signal + p["m"] + p["u"] * x / F.col("capacity")


def conic_derivative(x: Column, p: dict[str, Column]) -> Column:
    gap, root, vs = _conic(x, p)
    c = F.col("capacity")
    signal = (
        F.when(vs <= 0.875, p["s"] / p["sat"] / ((1 - vs) * (1 - vs)))
        .when(vs < 0.925, (p["cc"] + vs * (2 * p["cb"] + 3 * vs * p["ca"])) / p["sat"])
        .otherwise(F.lit(0.0))
    )
    return F.col("free_flow_time") * (p["a"] - p["a"] * p["a"] * gap / root) / c + signal + p["u"] / c


def conic_integral(*_: Column) -> Column:
    raise NotImplementedError("the objective of conical links is not defined; omit it")


def weights(toll_factor: Column, distance_factor: Column) -> tuple[Column, Column, Column]:
    """(time, toll, distance) weights of a class; a negative factor makes the class insensitive to time."""
    odd = (toll_factor < 0) | (distance_factor < 0)
    toll = F.when(odd, F.when(toll_factor < 0, 1.0).otherwise(0.0)).otherwise(toll_factor)
    return (
        F.when(odd, 0.0).otherwise(1.0),
        toll,
        F.when(odd, F.when(toll == 0, 1.0).otherwise(0.0)).otherwise(distance_factor),
    )


def np_cost(x, c, t0, a, b):
    """time, derivative and integral on arrays."""
    x, c, t0, a, b = (np.asarray(v, float) for v in (x, c, t0, a, b))
    y = np.maximum(x, 0) / c
    lin = b == 1
    time = np.where(lin, t0 * (1 + a * x / c), np.where(x > 0, t0 * (1 + a * y**b), t0))
    with np.errstate(divide="ignore", invalid="ignore"):
        der = np.where(lin, t0 * a / c, np.where(x > 0, t0 * a * b / c * y ** (b - 1), 0.0))
    area = np.where(lin, x * t0 * (1 + a * x / c / 2), x * t0 * (1 + a / (b + 1) * y**b))
    return time, der, area
