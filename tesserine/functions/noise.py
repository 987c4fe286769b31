"""Simplex noise in one, two and three dimensions and its fractal sum, as pandas functions over whole batches.

Noise is a gradient noise on the simplex grid: each corner within reach adds
(r^2 - d^2)^4 times the dot product of its gradient and the offset, and the
sum is scaled to about -1..1. A corner's gradient is that of the hash of its
grid coordinates, by a permutation of 0..255: Perlin's where there is no
seed, else one drawn by numpy's generator.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: K. Perlin's permutation, a byte each.
TABLE = np.frombuffer(
    bytes.fromhex(
        "97a0895b5a0f830dc95f6035c2e907e18c24671e458e086325f0150a17be0694f778ea4b001ac53e5efcdbcb75230b2039b12158ed953857ae147d88aba844af"
        "4aa547868b301ba64d929ee7536fe57a3cd385e6dc695c29372ef528f4668f3641193fa101d85049d14c84bbd05912a9c8c4878274bc9f56a4646dc6adba0340"
        "34d9e2fa7c7b05ca2693767eff5255d4cfce3be32f103a11b6bd1c2adfb7aad577f898022c9aa346dd99659ba72bac09811627fd13626c6e4f71e0e8b2b97068"
        "daf661e4fb22f2c1eed2900cbfb3a2f1513391ebf90eef6b31c0d61fb5c76a9db854ccb07379322d7f0496fe8aeccd5dde72431d1848f38d80c34e42d73d9cb4"
    ),
    np.uint8,
).astype(np.int64)
SCALE = {1: 0.395, 2: 45.23065, 3: 32.0}
REACH = {1: 1.0, 2: 0.5, 3: 0.6}


def gradients(d: int) -> np.ndarray:
    """The gradient of each hash, one row each: in 1D 1 to 8 of either sign, in 2D a whole and a double step, in 3D the middles of a cube's edges."""
    out = np.zeros(({1: 16, 2: 64, 3: 16}[d], d))
    for h, g in enumerate(out):
        if d == 1:
            g[0] = (1 + h % 8) * (-1 if h & 8 else 1)
            continue
        if d == 2:
            axes, size = (0, 1) if h < 4 else (1, 0), (1, 2)
        else:
            axes, size = (0 if h < 8 else 1, 1 if h < 4 else 0 if h in (12, 14) else 2), (1, 1)
        for bit, axis, step in zip((1, 2), axes, size, strict=True):
            g[axis] = -step if h & bit else step
    return out


GRADIENTS = {d: gradients(d) for d in (1, 2, 3)}


def permutation(seed: int | None = None) -> np.ndarray:
    return TABLE if seed is None else np.random.default_rng(seed).permutation(256)


def simplex(points: np.ndarray, perm: np.ndarray) -> np.ndarray:
    """Noise at rows of points; near -1 to 1, 0 at the grid's corners."""
    n, d = points.shape
    skew = (np.sqrt(d + 1) - 1) / d if d > 1 else 0.0
    unskew = (1 - 1 / np.sqrt(d + 1)) / d if d > 1 else 0.0
    base = np.floor(points + points.sum(1, keepdims=True) * skew)
    first = points - (base - base.sum(1, keepdims=True) * unskew)
    order = np.argsort(-first, axis=1, kind="stable")
    corner = np.zeros((n, d))
    out = np.zeros(n)
    for k in range(d + 1):
        if k:
            corner[np.arange(n), order[:, k - 1]] += 1
        offset = first - corner + k * unskew
        at = ((base + corner).astype(np.int64)) & 255
        h = perm[at[:, d - 1]]
        for j in range(d - 2, -1, -1):
            h = perm[(at[:, j] + h) & 255]
        g = GRADIENTS[d]
        fall = np.maximum(REACH[d] - (offset**2).sum(1), 0)
        out += fall**4 * (g[h % len(g)] * offset).sum(1)
    return SCALE[d] * out


def fractal(points: np.ndarray, perm: np.ndarray, octaves: int, frequency: float = 1.0, amplitude: float = 1.0, lacunarity: float = 2.0, persistence: float = 0.5) -> np.ndarray:
    """Octaves of noise, each at a higher frequency and lower amplitude, over the sum of amplitudes."""
    if octaves < 1:
        raise ValueError("octaves must be 1 or more")
    out, total = np.zeros(len(points)), 0.0
    for _ in range(octaves):
        out += amplitude * simplex(points * frequency, perm)
        total += amplitude
        frequency *= lacunarity
        amplitude *= persistence
    return out / total


def noise(*coordinates: Column, seed: int | None = None, octaves: int = 1, **options: float) -> Column:
    """Fractal noise at one, two or three coordinate columns; null where a coordinate is."""
    perm = permutation(seed)

    @F.pandas_udf("double")
    def run(points: pd.DataFrame) -> pd.Series:
        values = points.to_numpy(float)
        ok = ~np.isnan(values).any(1)
        out = np.full(len(values), np.nan)
        out[ok] = fractal(values[ok], perm, octaves, **options)
        return pd.Series(out).where(ok)

    return run(F.struct(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(coordinates))))


def graph_noise(node_noise_src: Column, node_noise_dst: Column, weight: float) -> Column:
    """What noise adds to an edge."""
    return F.lit(weight) * ((2 + node_noise_src) + (2 + node_noise_dst)) / 2
