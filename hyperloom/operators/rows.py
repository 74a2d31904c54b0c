"""Rows as vectors, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import combinations
from typing import Protocol

import numpy as np

from hyperloom.architectures import BSC, HRR, MAP, Architecture
from hyperloom.functions import kernels

#: Elements of a matrix that one step works on, and of the cell vectors that a task remembers.
STEP_ELEMENTS = 1 << 22
CACHE_ELEMENTS = 1 << 25


class Encoding(Protocol):
    """How a cell becomes a vector."""

    def cell(self, arch: Architecture, size: int, column: str, position: int, value: str) -> np.ndarray: ...


class ByColumn:
    """The column's symbol bound with the value's; the column stands left."""

    def cell(self, arch: Architecture, size: int, column: str, position: int, value: str) -> np.ndarray:
        return kernels.bind(arch.kind, kernels.symbol(arch, column, size), kernels.symbol(arch, value, size))


class ByPosition:
    """The value's symbol, rotated by the column's position."""

    def cell(self, arch: Architecture, size: int, column: str, position: int, value: str) -> np.ndarray:
        return kernels.permute(kernels.symbol(arch, value, size), position)


ENCODINGS: dict[str, Encoding] = {"column": ByColumn(), "position": ByPosition()}


def encoding_of(encoding: str | Encoding) -> Encoding:
    if isinstance(encoding, str):
        if encoding not in ENCODINGS:
            raise ValueError(f"unknown encoding {encoding!r}: one of {', '.join(ENCODINGS)}")
        return ENCODINGS[encoding]
    return encoding


class RowKernel:
    """Evaluates one row operation, "bundle", "bind" or "combos", over batches of rows.

    Null cells are skipped; a row without cells has no vector. ``normalized`` applies to the row.
    ``codes`` gives the categories of columns whose cells are integer codes.

    Where products don't depend on order and sums are plain, the products of up to ``ways`` cells are
    elementary symmetric polynomials of the cells: each cell x turns the sum e_k of k-fold products
    into e_k + x e_(k-1), element by element for MAP and on spectra for HRR. That takes columns x
    ways steps. VTB and BSC go through the combinations, of which neighbours share their first factors.
    """

    def __init__(
        self,
        arch: Architecture,
        size: int,
        columns: Sequence[str],
        encoding: Encoding,
        op: str,
        *,
        normalized: bool,
        ways: int = 1,
        codes: Mapping[int, Sequence[str]] | None = None,
    ) -> None:
        self.arch, self.size, self.columns, self.encoding = arch, size, list(columns), encoding
        self.op, self.normalized, self.ways, self.codes = op, normalized, ways, dict(codes or {})
        self.cells: dict[tuple[int, str | int], np.ndarray] = {}
        self.spectra: dict[tuple[int, str | int], np.ndarray] = {}

    @property
    def symmetric(self) -> bool:
        """Whether combinations are taken by the recurrence."""
        return self.op == "combos" and self.arch.kind in (MAP, HRR)

    @property
    def step(self) -> int:
        """Rows that a call should take, by the matrices that it holds at once."""
        held = 1 if self.op != "combos" else self.ways + 1 if self.symmetric else self.ways + len(self.columns)
        return max(1, STEP_ELEMENTS // (self.size * held))

    def cell(self, k: int, value: str | int) -> np.ndarray:
        if (k, value) not in self.cells:
            if len(self.cells) * self.size > CACHE_ELEMENTS:
                self.cells.clear()
            name = self.codes[k][value] if k in self.codes else value
            self.cells[k, value] = self.encoding.cell(self.arch, self.size, self.columns[k], k, name)
        return self.cells[k, value]

    def _spectrum(self, k: int, value: str | int) -> np.ndarray:
        if (k, value) not in self.spectra:
            if len(self.spectra) * self.size > CACHE_ELEMENTS:
                self.spectra.clear()
            self.spectra[k, value] = np.fft.rfft(self.cell(k, value))
        return self.spectra[k, value]

    def _column(self, k: int, values: Sequence[str | int | None], *, spectra: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Vectors (or spectra) of one column's cells, zero where there is none, and which of them there are."""
        there = np.array([v is not None for v in values], bool)
        width, kind = (self.size // 2 + 1, np.complex128) if spectra else (self.size, np.float64 if self.arch.real else np.int8)
        out = np.zeros((len(values), width), kind)
        codes: dict[str | int, list[int]] = {}
        for i, v in enumerate(values):
            if v is not None:
                codes.setdefault(v, []).append(i)
        for value, at in codes.items():
            out[at] = self._spectrum(k, value) if spectra else self.cell(k, value)
        return out, there

    def __call__(self, values: Sequence[Sequence[str | int | None]], ordinals: Sequence[object]) -> tuple[np.ndarray, np.ndarray]:
        """For columns of cells: a matrix with a vector per row, and which rows have one."""
        cells = (self._column(k, v) for k, v in enumerate(values))
        if self.op == "bind":
            return self._fold(cells)
        if self.symmetric:
            acc, valid = self._symmetric(values, len(ordinals))
        else:
            acc, valid = self._bundle(cells if self.op == "bundle" else self._combinations(list(cells)), len(ordinals), ordinals)
        return (kernels.normalize(self.arch.kind, acc) if self.normalized else acc), valid

    def _fold(self, cells: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Cells bound from left to right."""
        cells = iter(cells)
        acc, valid = next(cells)
        for vec, there in cells:
            both = valid & there
            if both.any():
                acc[both] = kernels.bind(self.arch.kind, acc[both], vec[both])
            fresh = there & ~valid
            acc[fresh] = vec[fresh]
            valid = valid | there
        return acc, valid

    def _symmetric(self, values: Sequence[Sequence[str | int | None]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum of all products of 1 to ``ways`` cells by the recurrence; a missing cell adds nothing."""
        spectra = self.arch.kind == HRR
        width = self.size // 2 + 1 if spectra else self.size
        sums = [np.zeros((n, width), np.complex128 if spectra else np.int64) for _ in range(self.ways)]
        valid = np.zeros(n, bool)
        for k, column in enumerate(values):
            x, there = self._column(k, column, spectra=spectra)
            for w in range(min(k, self.ways - 1), 0, -1):
                sums[w] += x * sums[w - 1]
            if sums:
                sums[0] += x
            valid |= there
        if not sums:
            return np.zeros((n, self.size), kernels.zero_dtype(self.arch.kind)), np.zeros(n, bool)
        for more in sums[1:]:
            sums[0] += more
        return (np.fft.irfft(sums[0], self.size) if spectra else sums[0]), valid

    def _combinations(self, cells: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Products of 1, 2, ... ``ways`` cells in the order of columns, for rows that have all of them.
        Only the products of one combination's first factors are held."""
        for n in range(1, self.ways + 1):
            path: list[tuple[np.ndarray, np.ndarray]] = []
            before: tuple[int, ...] = ()
            for chosen in combinations(range(len(cells)), n):
                same = next((i for i, (a, b) in enumerate(zip(before, chosen, strict=False)) if a != b), 0)
                del path[same:]
                for k in chosen[same:]:
                    vec, there = cells[k]
                    if path:
                        acc, valid = path[-1][0].copy(), path[-1][1] & there
                        if valid.any():
                            acc[valid] = kernels.bind(self.arch.kind, acc[valid], vec[valid])
                        vec, there = acc, valid
                    path.append((vec, there))
                before = chosen
                yield path[-1]

    def _bundle(self, terms: Iterable[tuple[np.ndarray, np.ndarray]], n: int, ordinals: Sequence[object]) -> tuple[np.ndarray, np.ndarray]:
        acc = np.zeros((n, self.size), kernels.zero_dtype(self.arch.kind))
        valid = np.zeros(n, bool)
        for k, (vec, there) in enumerate(terms):
            if self.arch.kind == BSC:
                both = np.flatnonzero(there & valid)
                if len(both):
                    drawn = kernels.ties(self.arch, self.size, [("cell", ordinals[i], k) for i in both])
                    acc[both] = np.where(acc[both] == vec[both], acc[both], drawn)
                fresh = there & ~valid
                acc[fresh] = vec[fresh]
            else:
                acc[there] += vec[there]
            valid |= there
        return acc, valid
