"""Inverse of the normal distribution function: Wichura's algorithm AS 241 (PPND16), for 1e-10 < p < 1 - 1e-10."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surety.functions.columns import col

#: Coefficients as published, constant term first.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
SPLIT, CENTRE_R, TAIL_R = 0.425, 0.180625, 1.6


def _horner(r: Column, terms) -> Column:
    out = F.lit(terms[-1])
    for t in reversed(terms[:-1]):
        out = out * r + F.lit(t)
    return out


def probit(p) -> Column:
    p = col(p)
    q = p - 0.5
    inner = F.lit(CENTRE_R) - q * q
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p))) - TAIL_R
    tail = _horner(r, TAIL[0]) / _horner(r, TAIL[1])
    return F.when(F.abs(q) <= SPLIT, q * _horner(inner, CENTRE[0]) / _horner(inner, CENTRE[1])).otherwise(F.when(q < 0, -tail).otherwise(tail))


def _horner_sql(r: str, terms) -> str:
    out = f"{terms[-1]!r}::DOUBLE"
    for t in reversed(terms[:-1]):
        out = f"({out} * {r} + {t!r}::DOUBLE)"
    return out


def probit_sql(p: str) -> str:
    """The same function as SQL text."""
    q, inner = f"(({p}) - 0.5)", f"({CENTRE_R} - (({p}) - 0.5) * (({p}) - 0.5))"
    r = f"(sqrt(-ln(least({p}, 1.0 - ({p})))) - {TAIL_R})"
    tail = f"({_horner_sql(r, TAIL[0])} / {_horner_sql(r, TAIL[1])})"
    return f"CASE WHEN abs({q}) <= {SPLIT} THEN {q} * {_horner_sql(inner, CENTRE[0])} / {_horner_sql(inner, CENTRE[1])} WHEN {q} < 0 THEN -{tail} ELSE {tail} END"
