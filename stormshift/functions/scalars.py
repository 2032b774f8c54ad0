"""Scalar formulas of the study as SQL text."""

from __future__ import annotations

from stormshift.functions.text import num


def center(origin: str, index: str, cell: str) -> str:
    """Coordinate of a cell's centre."""
    return f"({origin} + (5e-1 + {index}) * {cell})"


def return_period(exceedance: str, per_year: float) -> str:
    """Years; null where the exceedance is 0 (an infinite period). The exponent is small, so 1 - exp(-t) is written with care."""
    return f"(CASE WHEN {exceedance} > 0e0 THEN 1e0 / -expm1(-{num(per_year)} * {exceedance}) END)"


def short(q: str) -> str:
    """A number cut to 32 bits, by additions that every engine rounds alike; as it is where these would overflow."""
    big = f"({q} * {num(2.0**21 + 1)})"
    return f"(CASE WHEN abs({q}) < 1e300 THEN {big} - ({big} - {q}) ELSE {q} END)"


def inches(mm: str) -> str:
    return f"({mm} / 2.54e1)"


def reward(depth: str, threshold: str) -> str:
    """The depth if it reaches the threshold, else 0."""
    return f"(CASE WHEN {depth} >= {threshold} THEN {depth} ELSE 0e0 END)"


def responsibility(mix: str, narrow: str, wide: str, floor: float = 1e-300) -> str:
    """Probability that a draw came from the narrow component of a mixture."""
    return f"({mix} * {narrow} / greatest({mix} * {narrow} + (1e0 - {mix}) * {wide}, {num(floor)}))"
