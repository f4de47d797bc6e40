"""Distances and forces on coordinate columns and coordinate arrays."""

from __future__ import annotations

from collections.abc import Sequence

from outskirt.functions.numeric import round_to

# Up to this width an array expression is written out term by term, which Spark
# compiles; wider arrays use higher-order functions.
UNROLL_DIMS = 16


def items(array: str, dims: int) -> list[str]:
    return [f"{array}[{i}]" for i in range(dims)]


def l2(a: Sequence[str], b: Sequence[str], scale: int | None = 2) -> str:
    squares = [f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b, strict=True)]
    return round_to(f"sqrt({' + '.join(squares)})", scale)


def force(a: str, b: str, d: str) -> str:
    """Unrounded force component of one dimension: ``(a - b) * d^2``."""
    return f"({a} - {b}) * ({d} * {d})"


def norm(parts: Sequence[str], scale: int | None = 2, wide: bool = False) -> str:
    return round_to(f"sqrt({' + '.join(f'{v} * {v}' for v in parts)})", scale, wide)


def nearest_and_farthest(c: str, lo: str, hi: str, dims: int, metric: str = "l2") -> tuple[str, str]:
    """Smallest and largest distance of point ``c`` to the box ``[lo, hi]``."""
    if dims <= UNROLL_DIMS:
        sides = list(zip(items(c, dims), items(lo, dims), items(hi, dims)))
        near = [f"greatest({a} - {v}, {v} - {b}, 0.0D)" for v, a, b in sides]
        far = [f"greatest({v} - {a}, {b} - {v})" for v, a, b in sides]
        if metric == "l1":
            return " + ".join(near), " + ".join(far)
        return norm(near, None), norm(far, None)
    below = f"zip_with({lo}, {c}, (a, v) -> a - v)"
    above = f"zip_with({c}, {hi}, (v, b) -> v - b)"
    near = f"zip_with({below}, {above}, (a, b) -> greatest(a, b, 0.0D))"
    far = f"zip_with({below}, {above}, (a, b) -> greatest(-a, -b))"
    return _length(near, metric), _length(far, metric)


def box_centre(lo: Sequence[str], hi: Sequence[str]) -> list[str]:
    return [f"(({a} + {b}) / 2.0D)" for a, b in zip(lo, hi, strict=True)]


def _length(gaps: str, metric: str) -> str:
    if metric == "l1":
        return f"aggregate({gaps}, 0.0D, (s, g) -> s + abs(g))"
    return f"sqrt(aggregate({gaps}, 0.0D, (s, g) -> s + g * g))"
