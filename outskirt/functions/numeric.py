"""Rounding and guards.

All rounding is ``floor(v * 10^s + 0.5) / 10^s`` on doubles, which Spark, numpy
and other SQL engines evaluate to the same bits; ``round`` differs between them.
"""

from __future__ import annotations


def lit(value: float) -> str:
    """A double literal."""
    if value in (float("inf"), float("-inf")):
        return f"double('{value}')"
    return f"{float(value)!r}D"


def unit(scale: int) -> str:
    return lit(10**scale)


# From here on a double has no fraction.
WHOLE = "9007199254740992.0D"


def round_to(v: str, scale: int | None, wide: bool = False) -> str:
    """``wide``: values may be so large that ``floor`` would leave the BIGINT range; such values have nothing to round."""
    if scale is None:
        return v
    rounded = f"(floor(({v}) * {unit(scale)} + 0.5D) / {unit(scale)})"
    return f"if(abs({v}) * {unit(scale)} < {WHOLE}, {rounded}, {v})" if wide else rounded


def scaled(v: str, scale: int, wide: bool = False) -> str:
    """``v`` in units of ``10^-scale`` as BIGINT, or DECIMAL if ``wide``, so that sums do not depend on order."""
    whole = f"floor(({v}) * {unit(scale)} + 0.5D)"
    if not wide:
        return f"cast({whole} as bigint)"
    large = f"cast(({v}) * {unit(scale)} as decimal(38,0))"
    return f"if(abs({v}) * {unit(scale)} < {WHOLE}, cast({whole} as decimal(38,0)), {large})"


def zero(wide: bool) -> str:
    return "cast(0 as decimal(38,0))" if wide else "0L"


def round_up(v: str, scale: int) -> str:
    return f"(ceil(({v}) * {unit(scale)}) / {unit(scale)})"


def finite_or_zero(v: str) -> str:
    return f"if({v} is null or isnan({v}) or abs({v}) = double('inf'), 0.0D, {v})"
