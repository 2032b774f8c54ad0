"""Albers equal-area projection of longitude and latitude, after Snyder, USGS Professional Paper 1395."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormshift.functions.text import num


@dataclass(frozen=True)
class Albers:
    """GRS80, parallels 29.5 and 45.5, origin 23 N 96 W by default; metres."""

    a: float = 6378137.0
    e2: float = 0.0066943800229034
    parallels: tuple[float, float] = (29.5, 45.5)
    origin: tuple[float, float] = (23.0, -96.0)

    def _q(self, sin: str) -> str:
        e = num(math.sqrt(self.e2))
        return f"({num(1 - self.e2)} * ({sin} / (1e0 - {num(self.e2)} * {sin} * {sin}) - ln((1e0 - {e} * {sin}) / (1e0 + {e} * {sin})) / (2e0 * {e})))"

    def sql(self, lon: str, lat: str) -> tuple[str, str]:
        """x and y as SQL text."""
        p1, p2 = map(math.radians, self.parallels)
        m = lambda p: math.cos(p) / math.sqrt(1 - self.e2 * math.sin(p) ** 2)
        e = math.sqrt(self.e2)
        q = lambda p: (1 - self.e2) * (math.sin(p) / (1 - self.e2 * math.sin(p) ** 2) - math.log((1 - e * math.sin(p)) / (1 + e * math.sin(p))) / (2 * e))
        n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
        c = m(p1) ** 2 + n * q(p1)
        rho0 = self.a * math.sqrt(c - n * q(math.radians(self.origin[0]))) / n
        rho = f"({num(self.a / n)} * sqrt({num(c)} - {num(n)} * {self._q(f'sin(radians({lat}))')}))"
        theta = f"({num(n)} * radians({lon} - {num(self.origin[1])}))"
        return f"({rho} * sin({theta}))", f"({num(rho0)} - {rho} * cos({theta}))"

    def columns(self, lon: str, lat: str) -> tuple[Column, Column]:
        x, y = self.sql(lon, lat)
        return F.expr(x), F.expr(y)
