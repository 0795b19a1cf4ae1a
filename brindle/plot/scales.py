"""Scales from data to pixels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal


def linear_scale(domain: tuple[float, float], extent: tuple[float, float]) -> Callable[[float], float]:
    """Proportional; a domain of one value maps to the middle."""
    width = domain[1] - domain[0]
    if width == 0:
        return lambda v: sum(extent) / 2
    slope = (extent[1] - extent[0]) / width
    return lambda v: extent[0] + (v - domain[0]) * slope


def ordinal_scale(domain: Sequence[str], extent: tuple[float, float]) -> tuple[Callable[[str], float], float]:
    """Centres of equal bands in order of the domain, and the band's width; unknown values are at the start."""
    band = (extent[1] - extent[0]) / len(domain) if domain else 0.0
    centre = {v: extent[0] + band * (i + 0.5) for i, v in enumerate(domain)}
    return lambda v: centre.get(v, extent[0]), band


def nice_step(width: float, target: int) -> Decimal:
    """The smallest of 1, 2 and 5 times the powers of ten that divides width into at most target steps; exact in decimals."""
    least = Decimal(width) / target
    power = Decimal(1).scaleb(least.adjusted())
    return next(step for m in (1, 2, 5, 10) if (step := m * power) >= least)


def nice_ticks(low: float, high: float, target: int = 5) -> list[float]:
    """The multiples of a nice step from the last one at or below low to the first one at or above high."""
    if low == high:
        return [low]
    step = nice_step(high - low, target)
    first, last = math.floor(Decimal(low) / step), math.ceil(Decimal(high) / step)
    return [float(k * step) for k in range(first, last + 1)]


def domain_of(values: Sequence[float], nice: bool = True) -> tuple[float, float]:
    """Least and greatest value, widened to ticks; a single value gets half its size on both sides, nothing and zero the unit."""
    low, high = min(values, default=0), max(values, default=0)
    if low == high:
        return (low - abs(low) / 2, high + abs(high) / 2) if low else (0.0, 1.0)
    if not nice:
        return low, high
    ticks = nice_ticks(low, high)
    return ticks[0], ticks[-1]
