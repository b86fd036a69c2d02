"""Exact integer matrix products through float64 BLAS.

Integers are broken into limbs so small that no sum of limb products reaches 2^53; each
limb product is then exact in float64, and the products are put together in int64.
"""

from __future__ import annotations

import numpy as np

EXACT = 53  # float64 holds all integers up to 2^53


def limb_bits(length: int) -> int:
    """Bits per limb such that a dot product of ``length`` limb pairs stays below 2^53."""
    return (EXACT - 1 - max(1, length - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs of int64 values, lowest first: x = sum of limb_i * 2^(bits * i), |limb| < 2^bits, signs as in x."""
    sign, rest, out = np.sign(x).astype(np.float64), np.abs(x), []
    while True:
        out.append((rest & ((1 << bits) - 1)) * sign)
        rest = rest >> bits
        if not rest.any():
            return out


def exact_product(a: list[np.ndarray], b: list[np.ndarray], bits: int) -> np.ndarray:
    """a @ b.T of two matrices given by their limbs, in int64 (the true result must fit)."""
    total = None
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            part = (x @ y.T).astype(np.int64)
            part = part << (bits * (i + j)) if i + j else part
            total = part if total is None else total + part
    return total


def largest_component(length: int) -> int:
    """The largest |x| for which the squared distance of two vectors of this length surely fits into 63 bits."""
    return int((2**62 // (4 * max(1, length))) ** 0.5)


def floor_scaled(values: np.ndarray, scale: int, length: int) -> np.ndarray:
    """floor(scale * x) in int64; refuses components whose products could leave 63 bits."""
    out = np.floor(values.astype(np.float64) * scale)
    if out.size and np.abs(out).max() > largest_component(length):
        raise ValueError(f"a component is too large: at most {largest_component(length) / scale:g} can be coded exactly")
    return out.astype(np.int64)
