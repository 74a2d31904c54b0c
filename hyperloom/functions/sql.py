"""The algebra for SQL: functions over array columns, registered under hv_ names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hyperloom.architectures import Architecture
from hyperloom.functions import kernels


def register(spark: SparkSession, arch: Architecture, prefix: str = "hv_") -> list[str]:
    """Register ``symbol(name, size)``, ``bind``, ``bundle``, ``permute(vec, n)``, ``normalize``,
    ``similarity`` and, where there is one, ``inverse`` for ``arch``; returns their names.

    They take and give arrays, in Arrow batches that are worked on as matrices. BSC has no ``bundle``: it needs tie bits.
    """
    kind = arch.kind
    normal, acc = f"array<{arch.element()}>", f"array<{arch.element(False)}>"
    number = np.float64 if arch.real else np.int64

    def each(f, *columns: pd.Series) -> pd.Series:
        """``f`` on one matrix for each combination of sizes (and of plain numbers); null where an argument is."""
        out: list = [None] * len(columns[0])
        alike: dict[tuple, list[int]] = {}
        for i, row in enumerate(zip(*columns, strict=True)):
            if all(v is not None and not (np.isscalar(v) and pd.isna(v)) for v in row):
                alike.setdefault(tuple(v if np.isscalar(v) else (len(v),) for v in row), []).append(i)
        for key, at in alike.items():
            matrices = [k if np.isscalar(k) else np.stack([np.asarray(c.iloc[i], number) for i in at]) for k, c in zip(key, columns, strict=True)]
            for i, value in zip(at, f(*matrices), strict=True):
                out[i] = value
        return pd.Series(out)

    def symbol(name: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([None if n is None or pd.isna(s) else kernels.symbol(arch, n, int(s)) for n, s in zip(name, size, strict=True)])

    def bind(a: pd.Series, b: pd.Series) -> pd.Series:
        return each(lambda x, y: kernels.bind(kind, x, y), a, b)

    def bundle(a: pd.Series, b: pd.Series) -> pd.Series:
        return each(lambda x, y: x + y, a, b)

    def permute(a: pd.Series, n: pd.Series) -> pd.Series:
        return each(lambda x, s: kernels.permute(x, int(s)), a, n)

    def normalize(a: pd.Series) -> pd.Series:
        return each(lambda x: kernels.normalize(kind, x), a)

    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return each(lambda x, y: kernels.similarity(kind, x, y).tolist(), a, b)

    def inverse(a: pd.Series) -> pd.Series:
        return each(lambda x: kernels.inverse(kind, x), a)

    found = {"symbol": (symbol, normal), "bind": (bind, normal), "permute": (permute, normal), "normalize": (normalize, normal), "similarity": (similarity, "double")}
    if arch.additive:
        found["bundle"] = (bundle, acc)
    if not arch.self_inverse:
        found["inverse"] = (inverse, normal)
    for name, (f, kind_) in found.items():
        spark.udf.register(prefix + name, F.pandas_udf(f, kind_))
    return sorted(prefix + name for name in found)
