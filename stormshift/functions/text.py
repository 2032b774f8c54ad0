"""Numbers in SQL text that both engines read as doubles."""

from __future__ import annotations


def num(x: float) -> str:
    s = repr(float(x))
    s = s if "e" in s else s + "e0"
    return f"({s})" if s.startswith("-") else s


def horner(coefficients: tuple, x: str) -> str:
    """Polynomial in x, highest power first."""
    first, *rest = coefficients
    out = num(first)
    for c in rest:
        out = f"({out} * {x} + {num(c)})"
    return out
