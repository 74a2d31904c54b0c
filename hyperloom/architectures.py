"""The four algebras, as plain values: what they store, and which sizes they accept."""

from __future__ import annotations

import math
from dataclasses import dataclass

BSC, MAP, HRR, VTB = "bsc", "map", "hrr", "vtb"
NAMES = {
    BSC: "BinarySpatterCode",
    MAP: "MultiplyAddPermute",
    HRR: "HolographicReducedRepresentation",
    VTB: "VectorDerivedTransformationBinding",
}
#: Spark element types of normalized vectors and of accumulators.
ELEMENTS = {BSC: ("tinyint", "tinyint"), MAP: ("tinyint", "bigint"), HRR: ("double", "double"), VTB: ("double", "double")}


@dataclass(frozen=True)
class Architecture:
    """An algebra with the seed (and optional stream) of its symbols.

    There is no mutable generator: a symbol's vector is a function of (seed, stream, name, size),
    the same in every store, session and task.
    """

    kind: str
    seed: int = 42
    stream: str = ""

    def __post_init__(self) -> None:
        if self.kind not in NAMES:
            raise ValueError(f"unknown architecture {self.kind!r}: one of {', '.join(NAMES)}")

    @property
    def name(self) -> str:
        return NAMES[self.kind]

    @property
    def self_inverse(self) -> bool:
        """Whether binding twice with the same vector undoes itself."""
        return self.kind in (BSC, MAP)

    @property
    def real(self) -> bool:
        return self.kind in (HRR, VTB)

    @property
    def additive(self) -> bool:
        """Whether bundling is a plain sum, so that equal terms can be counted."""
        return self.kind != BSC

    @property
    def commutative(self) -> bool:
        return self.kind != VTB

    @property
    def key(self) -> str:
        """What precedes a name in the text that is hashed to its vector."""
        return f"{self.seed}{'/' + self.stream if self.stream else ''}|"

    def element(self, normalized: bool = True) -> str:
        return ELEMENTS[self.kind][0 if normalized else 1]

    def valid_size(self, size: int) -> bool:
        return size > 0 and (self.kind != VTB or math.isqrt(size) ** 2 == size)

    def check_size(self, size: int) -> int:
        """``size`` if it is valid, else ValueError."""
        if size <= 0:
            raise ValueError("size must be > 0")
        if not self.valid_size(size):
            raise InvalidSizeError
        return size


# The texts of the errors below are part of the interface.


class StorageError(ValueError):
    """What can be wrong with a table that is to become a codebook."""


class InvalidSizeError(StorageError):
    def __init__(self) -> None:
        super().__init__("invalid vector size for the architecture")



class InvalidDataTypeError(StorageError):
    def __init__(self, column: str, kind: str) -> None:
        super().__init__(f"invalid data type for column '{column}': {kind}")


class SubsetError(ValueError):
    """What can be wrong with a table that is resolved against a codebook."""


class ColumnNotFoundError(SubsetError):
    def __init__(self, name: str) -> None:
        super().__init__(f"column '{name}' not found")


class ColumnTypeMismatchError(SubsetError):
    def __init__(self, name: str) -> None:
        super().__init__(f"column '{name}' has incompatible type")


class ValueNotFoundError(SubsetError):
    def __init__(self, column: str, value: str) -> None:
        super().__init__(f"value '{value}' not found in column '{column}'")
