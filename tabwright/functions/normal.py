"""Standard normal distribution as Columns (Spark has neither erf nor probit)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Acklam's rational approximation of the inverse normal CDF
# (relative error below 1.2e-9).
PROBIT_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PROBIT_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01, 1.0)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00, 1.0)
PROBIT_LOW = 0.02425

# Hart's rational approximation of the normal CDF in the form
# published by West (2005), double precision.
CDF_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
         112.079291497871, 221.213596169931, 220.206867912376)
CDF_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
         296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_TAIL = 7.07106781186547


def _horner(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Inverse normal CDF; null outside (0, 1)."""
    low, high = F.lit(PROBIT_LOW), F.lit(1 - PROBIT_LOW)
    q = p - 0.5
    r = q * q
    mid = _horner(PROBIT_A, r) * q / _horner(PROBIT_B, r)
    tail_low = F.sqrt(-2 * F.log(p))
    tail_high = F.sqrt(-2 * F.log(1 - p))
    left = _horner(PROBIT_C, tail_low) / _horner(PROBIT_D, tail_low)
    right = -_horner(PROBIT_C, tail_high) / _horner(PROBIT_D, tail_high)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p < low, left).when(p <= high, mid).otherwise(right))


def probit_values(p: np.ndarray) -> np.ndarray:
    """:func:`probit` of numbers inside (0, 1)."""
    def horner(coefs, x):
        out = np.full_like(x, coefs[0])
        for c in coefs[1:]:
            out = out * x + c
        return out
    q = p - 0.5
    r = q * q
    out = horner(PROBIT_A, r) * q / horner(PROBIT_B, r)
    for tail, sign, side in ((p < PROBIT_LOW, 1, p), (p > 1 - PROBIT_LOW, -1, 1 - p)):
        t = np.sqrt(-2 * np.log(side[tail]))
        out[tail] = sign * horner(PROBIT_C, t) / horner(PROBIT_D, t)
    return out


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    inner = e * _horner(CDF_P, a) / _horner(CDF_Q, a)
    frac = a + 0.65
    for k in (4, 3, 2, 1):
        frac = a + k / frac
    tail = F.when(a > 37, F.lit(0.0)).when(a < CDF_TAIL, inner).otherwise(e / frac / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def probit_sql(p: str) -> str:
    """The same approximation as SQL text."""
    def horner(coefs, x):
        out = f"{coefs[0]!r}::DOUBLE"
        for c in coefs[1:]:
            out = f"(({out})*({x})+({c!r})::DOUBLE)"
        return out
    q, r = f"(({p})-0.5::DOUBLE)", f"pow(({p})-0.5::DOUBLE,2)"
    lo, hi = f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-({p})))"
    return (f"(CASE WHEN ({p})<=0 OR ({p})>=1 THEN NULL WHEN ({p})<{PROBIT_LOW} THEN "
            f"{horner(PROBIT_C, lo)}/{horner(PROBIT_D, lo)} WHEN ({p})<=1-{PROBIT_LOW} THEN "
            f"{horner(PROBIT_A, r)}*{q}/{horner(PROBIT_B, r)} ELSE "
            f"-({horner(PROBIT_C, hi)})/{horner(PROBIT_D, hi)} END)")


def normal_cdf_sql(x: str) -> str:
    """:func:`normal_cdf` as SQL text."""
    def horner(coefs, v):
        out = f"{coefs[0]!r}::DOUBLE"
        for c in coefs[1:]:
            out = f"(({out})*({v})+({c!r})::DOUBLE)"
        return out
    a, e = f"abs({x})", f"exp(-pow({x},2)/2)"
    frac = f"({a}+0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        frac = f"({a}+{k}/{frac})"
    tail = (f"(CASE WHEN {a}>37 THEN 0 WHEN {a}<{CDF_TAIL!r}::DOUBLE THEN {e}*{horner(CDF_P, a)}/{horner(CDF_Q, a)} "
            f"ELSE {e}/{frac}/2.506628274631::DOUBLE END)")
    return f"(CASE WHEN ({x})>0 THEN 1-{tail} ELSE {tail} END)"
