"""Geometry of a segmentation: shape of the image, lattice of centers, thresholds. Plain Python, no Spark."""

from __future__ import annotations

import math
from dataclasses import dataclass


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def tiles(shape: tuple[int, int, int], side: int) -> tuple[int, int, int]:
    """How many tiles of a side lie along each axis of a box."""
    return tuple(ceil_div(n, side) for n in shape)


def canonical(shape: tuple[int, ...], multichannel: bool = True) -> tuple[tuple[int, int, int, int], bool]:
    """(Z, Y, X, C) of an array's shape, and whether it is 2-D."""
    if len(shape) not in (2, 3, 4):
        raise ValueError(f"an image has 2, 3 or 4 dimensions, not {len(shape)}")
    if len(shape) == 2:
        return (1, *shape, 1), True
    if len(shape) == 3:
        return ((1, *shape), True) if multichannel else ((*shape, 1), False)
    return tuple(shape), False


def wants_lab(channels: int, multichannel: bool, convert2lab: bool | None) -> bool:
    if not multichannel:
        return False
    if convert2lab and channels != 3:
        raise ValueError("Lab conversion needs three channels")
    return channels == 3 if convert2lab is None else bool(convert2lab)


@dataclass(frozen=True)
class SlicPlan:
    shape: tuple[int, int, int]
    channels: int
    is_2d: bool
    sp_shape: tuple[int, int, int]
    sp_grid: tuple[int, int, int]
    scale: float
    spacing: tuple[float, float, float]
    max_iter: int
    to_lab: bool
    connect: bool
    min_size: int
    max_size: int

    @property
    def n_centers(self) -> int:
        return math.prod(self.sp_grid)

    @property
    def spread(self) -> float:
        """What squared position differences are divided by."""
        return float(max(self.sp_shape) ** 2)


def plan(
    shape: tuple[int, ...], n_segments: float = 100, compactness: float = 1.0, spacing=(1, 1, 1), max_iter: int = 5, multichannel: bool = True,
    convert2lab: bool | None = None, enforce_connectivity: bool = True, min_size_factor: float = 0.4, max_size_factor: float = 10.0,
) -> SlicPlan:
    """All numbers of a segmentation, settled before any data is read. Fractional powers are taken here only, where they can't differ between engines."""
    (*box, channels), is_2d = canonical(shape, multichannel)
    if n_segments <= 0:
        raise ValueError("n_segments must be positive")
    if compactness == 0:
        raise ValueError("compactness must not be 0")
    if max_iter < 0:
        raise ValueError("max_iter must not be negative")
    side = math.ceil((math.prod(box) / n_segments) ** (1 / 2 if is_2d else 1 / 3))
    sp_shape = tuple(min(n, side) for n in box)
    sp_grid = tuple(ceil_div(n, s) for n, s in zip(box, sp_shape))
    segment = math.prod(box) / math.prod(sp_grid)
    return SlicPlan(
        tuple(box), channels, is_2d, sp_shape, sp_grid, 1.0 / compactness, tuple(float(s) for s in spacing), max_iter, wants_lab(channels, multichannel, convert2lab),
        enforce_connectivity, int(min_size_factor * segment), int(max_size_factor * segment),
    )
