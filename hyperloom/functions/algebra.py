"""What expressions do with vectors: on the driver, and on array columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import Column

from hyperloom.architectures import BSC, Architecture
from hyperloom.functions import kernels, vectors


class VectorAlgebra:
    """Normalized NumPy vectors: a sum is bundled from left to right and normalized once."""

    def __init__(self, arch: Architecture, size: int, steps: Callable[[], int] | None = None) -> None:
        self.arch, self.size = arch, size
        self.step = steps or count().__next__

    def bundle(self, acc: np.ndarray, vec: np.ndarray) -> np.ndarray:
        """One bundling step; BSC draws the tie bits of the next step."""
        if self.arch.kind == BSC:
            return np.where(acc == vec, acc, kernels.tie(self.arch, self.size, "step", self.step()))
        return acc + vec

    def add_many(self, terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        acc = kernels.denormalize(self.arch.kind, terms[0])
        for t in terms[1:]:
            acc = self.bundle(acc, t)
        return kernels.normalize(self.arch.kind, acc)

    def multiply(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return kernels.bind(self.arch.kind, left, right)

    def power(self, base: np.ndarray, exponent: int) -> np.ndarray:
        return kernels.permute(base, exponent)


class ColumnVectorAlgebra:
    """The same on array columns."""

    def __init__(self, arch: Architecture, size: int) -> None:
        self.arch, self.size = arch, size
        self.step = count().__next__

    def add_many(self, terms: list[Column]) -> Column:
        if len(terms) == 1:
            return terms[0]
        from pyspark.sql import functions as F

        acc = vectors.denormalize(self.arch, terms[0])
        for t in terms[1:]:
            tie = vectors.tie_bits(self.arch, self.size, F.lit("step"), F.lit(self.step())) if self.arch.kind == BSC else None
            acc = vectors.bundle(self.arch, acc, t, tie)
        return vectors.normalize(self.arch, acc)

    def multiply(self, left: Column, right: Column) -> Column:
        return vectors.bind(self.arch, left, right)

    def power(self, base: Column, exponent: int) -> Column:
        return vectors.permute(base, exponent)
