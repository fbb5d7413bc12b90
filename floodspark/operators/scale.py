"""Quantiles, median imputation and scalers (robust and standard), fitted on one frame and
applied to another.

Exact quantiles of any number of columns come from one distributed selection: a double's bits, turned so
that they order like the numbers, are read 16 at a time from the top. A pass counts, per column and
prefix still wanted, the values by their next 16 bits (tasks pre-aggregate, so at most 65,536 counts per column
and rank travel from a task), and the running sum of the counts tells where each rank goes on. Four passes
settle every rank of every column, at every size. No pass holds a column in one task or on the driver, which
gets one row per column and rank. ``exact=False`` uses ``percentile_approx`` (bounded sketch)."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_BITS, _PASSES = 16, 4


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit images of doubles that order like them (-0.0 counts as 0.0)."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def from_bits(u: int) -> float:
    raw = u ^ (1 << 63) if u >> 63 else ~u & (1 << 64) - 1
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _digits(columns: Sequence[str], prefixes: dict[int, list[int]], step: int):
    """Per task: how many values of each column go on from each wanted prefix with each next digit."""
    schema = pa.schema([("c", pa.int32()), ("prefix", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts = {(c, p): np.zeros(1 << _BITS, np.int64) for c, some in prefixes.items() for p in some}
        for b in batches:
            for c, name in enumerate(columns):
                x = b.column(c).drop_null().to_numpy(zero_copy_only=False)
                u = ordered_bits(x[~np.isnan(x)])
                digit = (u >> np.uint64(64 - _BITS * (step + 1)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                top = (u >> np.uint64(64 - _BITS * step)).astype(np.int64) if step else np.zeros(len(u), np.int64)
                for p in prefixes.get(c, ()):
                    counts[c, p] += np.bincount(digit[top == p], minlength=1 << _BITS)
        for (c, p), n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(np.full(len(at), p), pa.int64()),
                                              pa.array(at, pa.int32()), pa.array(n[at])], schema=schema)
    return run


def _selected(df: DataFrame, cols: Sequence[str], asks: list[tuple]) -> tuple[dict, dict]:
    """({ask: value}, {column number: number of values}). An ask is (column number, number, upper end, rank, quantile): the
    value of that rank, or, for rank None, of the rank below (or above) the quantile's place."""
    spark, total = df.sparkSession, {}
    d = cut(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]))
    wanted = {(c, i, up): (0, k) for c, i, up, k, _ in asks}              # prefix so far, rank among the values with it
    share = {(c, i, up): q for c, i, up, _, q in asks}
    for step in range(_PASSES):
        prefixes: dict[int, list[int]] = {}
        for (c, _, _), (p, _) in wanted.items():
            prefixes.setdefault(c, [])
            prefixes[c] += [p] if p not in prefixes[c] else []
        counted = (d.mapInArrow(_digits(d.columns, prefixes, step), "c int, prefix long, digit int, n long")
                   .groupBy("c", "prefix", "digit").agg(F.sum("n").alias("n")))
        w = Window.partitionBy("c", "prefix")                 # at most 65,536 rows each
        counted = counted.withColumns({"below": F.sum("n").over(w.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), "all": F.sum("n").over(w)})
        ask = spark.createDataFrame([(*key, p, k, share[key]) for key, (p, k) in wanted.items()],
                                    "c int, i int, up boolean, prefix long, k long, q double")
        place = (F.col("all") - 1) * F.col("q")
        rank = F.coalesce("k", F.when(F.col("up"), F.ceil(place)).otherwise(F.floor(place)))
        below = F.coalesce("below", F.lit(0))
        found = (counted.join(F.broadcast(ask), ["c", "prefix"]).withColumn("rank", rank)
                 .filter((below <= F.col("rank")) & (F.col("rank") < below + F.col("n")))
                 .select("c", "i", "up", "prefix", "digit", (F.col("rank") - below).alias("k"), "all").collect())     # one row per rank
        wanted = {(r["c"], r["i"], r["up"]): ((r["prefix"] << _BITS) + r["digit"], r["k"]) for r in found}
        total = total or {r["c"]: r["all"] for r in found}
        if not wanted:
            break
    return {key: from_bits(p) for key, (p, _) in wanted.items()}, total


def quantile_table(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list]:
    """Column -> linear-interpolated quantiles (the ``quantile_cont`` / numpy default definition) of its values that are
    neither NULL nor NaN; None for a column without values."""
    cols = list(cols)
    value, total = _selected(df, cols, [(c, i, up, None, float(q)) for c in range(len(cols)) for i, q in enumerate(qs) for up in (False, True)])
    out: dict[str, list] = {}
    for c, name in enumerate(cols):
        places = [(total.get(c, 0) - 1) * q for q in qs]
        ends = [(value.get((c, i, False)), value.get((c, i, True))) for i in range(len(qs))]
        out[name] = [a if a == b else a + (h - math.floor(h)) * (b - a) for (a, b), h in zip(ends, places)]
    return out


def quantiles(df: DataFrame, col: str, qs, exact: bool = True) -> list:
    qs = list(qs)
    if not exact:
        return list(df.agg(F.percentile_approx(col, qs, 10000).alias("v")).first()["v"])
    return quantile_table(df, [col], qs)[col]


def kth_smallest(df: DataFrame, col: str, k: int):
    """The k-th smallest (0-based) value of ``col`` that is neither NULL nor NaN; None where there are not so many."""
    return _selected(df, [col], [(0, 0, False, int(k), None)])[0].get((0, 0, False)) if k >= 0 else None


def quantile(df: DataFrame, col: str, q: float, exact: bool = True):
    return quantiles(df, col, [q], exact)[0]


def medians(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict:
    if not exact:
        return {c: quantile(df, c, 0.5, False) for c in cols}
    return {c: v[0] for c, v in quantile_table(df, cols, [0.5]).items()}


def median_impute(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Fill NULLs with the column median of ``fit`` (default: ``df`` itself)."""
    med = medians(fit if fit is not None else df, cols, exact)
    return df.fillna({c: v for c, v in med.items() if v is not None})


def robust_fit(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict:
    """Per column (median, q3 - q1), spread 0 -> 1."""
    out, qs = {}, (0.25, 0.5, 0.75)
    table = quantile_table(df, cols, qs) if exact else {c: quantiles(df, c, qs, False) for c in cols}
    for c in cols:
        q1, q2, q3 = table[c]
        spread = (q3 - q1) if q1 is not None else None
        out[c] = (q2, 1.0 if not spread else spread)
    return out


def robust_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, exact: bool = True) -> DataFrame:
    params = robust_fit(fit if fit is not None else df, cols, exact)
    return df.select(*[((F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c) if c in params else F.col(c)
                       for c in df.columns])


def standard_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; std 0 -> 1. Statistics of all columns in one aggregation of ``fit``."""
    src = fit if fit is not None else df
    facts = src.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()     # one row
    out = []
    for c in df.columns:
        if c in cols:
            mu, sd = (F.lit(facts[f"{n}_{c}"]).cast("double") for n in ("mean", "std"))
            out.append(((F.col(c) - mu) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
