"""The algebra on NumPy arrays whose last axis is the vector, for tasks and for single vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from hyperloom.architectures import BSC, HRR, MAP, VTB, Architecture


def _digits(prefix: str, names: list[str], blocks: int) -> np.ndarray:
    """For each name the hexadecimal digits of the digests of blocks 0, 1, ...: 32 each."""
    raw = b"".join(hashlib.md5(f"{prefix}{name}|{b}".encode()).digest() for name in names for b in range(blocks))
    data = np.frombuffer(raw, np.uint8)
    return np.stack([data >> 4, data & 15], axis=1).reshape(len(names), 32 * blocks)


def bits(prefix: str, names: list[str], size: int) -> np.ndarray:
    """A row of ``size`` bits for each name."""
    digits = _digits(prefix, names, -(-size // 128))
    return ((digits[:, :, None] >> np.arange(4, dtype=np.uint8)) & 1).reshape(len(names), -1)[:, :size]


def symbol(arch: Architecture, name: str, size: int) -> np.ndarray:
    """The vector of ``name``: the same as ``functions.symbols`` gives."""
    if not arch.real:
        found = bits(arch.key, [name], size)[0].astype(np.int8)
        return found if arch.kind == BSC else (2 * found - 1).astype(np.int8)
    digits = _digits(arch.key, [name], -(-size // 4)).reshape(-1, 8).astype(np.int64)
    values = (digits << (4 * np.arange(7, -1, -1))).sum(axis=1)[:size]
    return normalize(arch.kind, values * 2.0**-31 - 1.0)


def tie(arch: Architecture, size: int, *keys: object) -> np.ndarray:
    return ties(arch, size, [keys])[0]


def ties(arch: Architecture, size: int, keys: list[tuple]) -> np.ndarray:
    """A row of tie bits for each of ``keys``."""
    return bits(arch.key, ["|".join(["tie", *map(str, k)]) for k in keys], size).astype(np.int8)


def zero_dtype(kind: str) -> type:
    return {BSC: np.int8, MAP: np.int64}.get(kind, np.float64)


def bind(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if kind == BSC:
        return a ^ b
    if kind == MAP:
        return a * b
    n = a.shape[-1]
    if kind == HRR:
        return np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), n)
    d = math.isqrt(n)
    if d * d != n:
        raise ValueError("VTB vectors need a square size")
    left, right = a.reshape(*a.shape[:-1], d, d), b.reshape(*b.shape[:-1], d, d)
    out = math.sqrt(d) * (left @ np.swapaxes(right, -1, -2))
    return out.reshape(*out.shape[:-2], n)


def permute(vec: np.ndarray, shifts: int) -> np.ndarray:
    return np.roll(vec, shifts % vec.shape[-1] if vec.shape[-1] else 0, axis=-1)


def normalize(kind: str, acc: np.ndarray) -> np.ndarray:
    if kind == BSC:
        return acc
    if kind == MAP:
        return np.where(acc >= 0, 1, -1).astype(np.int8)
    norm = np.sqrt((acc * acc).sum(axis=-1, keepdims=True))
    return np.divide(acc, norm, out=acc.astype(np.float64), where=norm > 0)


def denormalize(kind: str, vec: np.ndarray) -> np.ndarray:
    return vec.astype(zero_dtype(kind))


def similarity(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if kind in (BSC, MAP):
        n = a.shape[-1]
        return (n - 2 * (a != b).sum(axis=-1)) / n
    norms = np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1))
    return np.divide((a * b).sum(axis=-1), norms, out=np.zeros(np.shape(norms)), where=norms > 0)


def inverse(kind: str, vec: np.ndarray) -> np.ndarray:
    n = vec.shape[-1]
    if kind == HRR:
        return np.roll(vec[..., ::-1], 1, axis=-1)
    if kind == VTB:
        d = math.isqrt(n)
        if d * d != n:
            raise ValueError("VTB vectors need a square size")
        return np.swapaxes(vec.reshape(*vec.shape[:-1], d, d), -1, -2).reshape(vec.shape)
    raise TypeError(f"{kind} vectors are their own inverse")
