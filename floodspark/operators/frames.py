"""Skew-safe keyed row frames.

The flood features count *rows*, not hours: "sum of the last 48 readings of this station". The
plain form, ``Window.partitionBy(station).orderBy(ts).rowsBetween(-47, 0)``, puts every reading of a
station into one task; with a handful of stations (or one station holding a third of the data) that
is one task per station over the whole history.

Here every row first gets its exact position inside its key (``row_index``) without a per-key task:

1. rows are range-partitioned by (key, time, tie-breaker) and sorted inside their partition; as the bounds are
   drawn from all order columns, a key with a third of the rows, or a burst of them in one minute, is
   spread over many partitions;
2. the sorted rows are numbered inside their partition and written (a lineage cut);
3. a small table of (key, partition) counts gives each part's offset inside the key;
4. position = offset + number inside the part.

There is one path, whatever the size of the data.

``framed`` then cuts each key into blocks of ``blockRows`` positions and copies the last ``lookback``
rows of a block into the next block (a halo). Windows run per (key, block), so a task never holds
more than ``blockRows + lookback`` rows, and every owned row still sees all of its predecessors:
results equal the plain per-key window exactly.

Unbounded prefixes (forward fill, running totals) use the same positions with a two-level scan:
inside a block, then across the small per-block summary table.

Setting (session conf): ``floodspark.frames.blockRows`` (default 1,048,576). The number of range
partitions is the session's shuffle width.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut

BLOCK_ROWS_CONF = "floodspark.frames.blockRows"
DEFAULT_BLOCK_ROWS = 1 << 20

POS = "_pos"        # 0-based position of the row inside its key
BLOCK = "_blk"      # block owning the row
FRAME = "_frame"    # block whose window this copy belongs to
OWN = "_own"        # copy is the owned one (not a halo copy)


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _conf_int(df: DataFrame, name: str, default: int) -> int:
    v = df.sparkSession.conf.get(name, None)
    return int(v) if v else default


def block_rows(df: DataFrame) -> int:
    return _conf_int(df, BLOCK_ROWS_CONF, DEFAULT_BLOCK_ROWS)


def ranged(df: DataFrame, order: Sequence[str], number: str = "_number") -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, written, with ``number``: it rises with the order, its
    upper 31 bits are the partition and its lower 33 bits the place inside."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(d.withColumn(number, F.monotonically_increasing_id()))


def row_index(df: DataFrame, key, order: Sequence[str], pos: str = POS,
              totals: dict[str, tuple[Column, Callable[[str], Column]]] | None = None) -> DataFrame:
    """Add ``pos``: the 0-based position of each row inside its key, in ``order``, and the ``totals`` of its key.

    ``order`` must be a total order inside a key (add a tie-breaker column). Position = rows of the key in earlier
    partitions (running sum over the small (key, partition) count table) + place among the key's rows of the
    partition. The numbered rows are materialised, so a recomputed task yields the same positions.
    totals: name -> (aggregate of a part, how the parts of a key are put together); they come with the parts' table, so
    rows are never joined by their key alone.
    """
    if pos in df.columns:        # already indexed upstream: reuse
        return df
    keys = _keys(key)
    d = ranged(df, [*keys, *order]).withColumn("_bkt", F.shiftright("_number", 33))
    # one row per (key, partition): at most keys + partitions rows
    totals = totals or {}
    stats = d.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_part_rows"), F.min("_number").alias("_first"),
                                         *[part.alias(name) for name, (part, _) in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = [f"_key{i}" for i in range(len(keys))]
    stats = stats.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_bkt").alias("_p"),
                         (F.coalesce(F.sum("_part_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                         *[merged(name).over(whole).alias(name) for name, (_, merged) in totals.items()])
    same = F.col("_bkt") == F.col("_p")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    out = d.join(stats, same).withColumn(pos, F.col("_shift") + F.col("_number"))
    return out.drop("_number", "_bkt", "_p", "_shift", *names)


def framed(df: DataFrame, key, order: Sequence[str], lookback: int) -> DataFrame:
    """Positions, blocks and halo copies so that windows of ``lookback`` preceding rows are exact."""
    lookback = max(int(lookback), 0)
    size = max(block_rows(df), lookback + 1)
    d = row_index(df, key, order)
    d = d.withColumn(BLOCK, F.expr(f"{POS} div {size}"))
    if lookback > 0:
        halo = (F.col(POS) % size) >= (size - lookback)
        d = d.withColumn(FRAME, F.explode(F.when(halo, F.array(F.col(BLOCK), F.col(BLOCK) + 1))
                                          .otherwise(F.array(F.col(BLOCK)))))
    else:
        d = d.withColumn(FRAME, F.col(BLOCK))
    return d.withColumn(OWN, F.col(FRAME) == F.col(BLOCK))


def frame_window(key) -> WindowSpec:
    return Window.partitionBy(*_keys(key), FRAME).orderBy(POS)


@dataclass(frozen=True)
class RowSpec:
    """A window feature over the rows of a key: needs ``lookback`` preceding rows."""
    lookback: int
    build: Callable[[WindowSpec], Column]


def with_row_features(df: DataFrame, key, order: Sequence[str], specs: dict[str, RowSpec],
                      keep_position: bool = False) -> DataFrame:
    """Compute all ``specs`` in one framed pass (one shuffle for the range index, one for frames)."""
    lookback = max((s.lookback for s in specs.values()), default=0)
    d = framed(df, key, order, lookback)
    w = frame_window(key)
    d = d.select("*", *[s.build(w).alias(name) for name, s in specs.items()])
    d = d.filter(F.col(OWN)).drop(BLOCK, FRAME, OWN)
    return d if keep_position else d.drop(POS)


# ---- feature specs ---------------------------------------------------------------------------

def _rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling_sum(col: str, n: int) -> RowSpec:
    """Sum of the last ``n`` rows (current included); NULLs skipped, NULL only if all are NULL."""
    return RowSpec(n - 1, lambda w: F.sum(col).over(_rows(w, n)))


def rolling_mean_full(col: str, n: int) -> RowSpec:
    """Mean of the last ``n`` rows, NULL unless all ``n`` values are present."""
    return RowSpec(n - 1, lambda w: F.when(F.count(col).over(_rows(w, n)) == n,
                                           F.avg(col).over(_rows(w, n))))


def rolling_std_full(col: str, n: int) -> RowSpec:
    """Sample standard deviation of the last ``n`` rows, NULL unless all ``n`` values are present."""
    return RowSpec(n - 1, lambda w: F.when(F.count(col).over(_rows(w, n)) == n,
                                           F.stddev_samp(col).over(_rows(w, n))))


def rolling_mean_partial(col: str, n: int) -> RowSpec:
    """Mean of the last ``n`` rows using whatever values exist (device history form)."""
    return RowSpec(n - 1, lambda w: F.avg(col).over(_rows(w, n)))


def lag_value(col: str, n: int = 1) -> RowSpec:
    return RowSpec(n, lambda w: F.lag(col, n).over(w))


def diff(col: str, n: int = 1) -> RowSpec:
    """Difference to the row ``n`` positions earlier in the same key."""
    return RowSpec(n, lambda w: F.col(col) - F.lag(col, n).over(w))


# ---- unbounded prefixes -----------------------------------------------------------------------

def _blocked(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    size = block_rows(df)
    return row_index(df, key, order).withColumn(BLOCK, F.expr(f"{POS} div {size}"))


def fill_forward_backward(df: DataFrame, key, order: Sequence[str], cols: Sequence[str],
                          default=0) -> DataFrame:
    """Per key: last non-NULL value before (forward fill), else first after (backward fill), else
    ``default``. Two-level scan: inside blocks, then over the per-block summary. What the forward fill
    leaves lies before the key's first value, so the backward fill is that one value per key."""
    keys = _keys(key)
    d = _blocked(df, key, order)
    past = Window.partitionBy(*keys, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    summ_aggs = []
    for c in cols:
        summ_aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"_last_{c}"),
                      F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"_first_{c}")]
    summ = d.groupBy(*keys, BLOCK).agg(*summ_aggs)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = []
    for c in cols:
        carry += [F.last(f"_last_{c}", True).over(before).alias(f"_cf_{c}"),
                  F.first(f"_first_{c}", True).over(whole).alias(f"_cb_{c}")]
    summ = summ.select(*keys, BLOCK, *carry)
    d = d.select("*", *[F.last(c, True).over(past).alias(f"_ff_{c}") for c in cols])
    d = d.join(summ, [*keys, BLOCK])
    for c in cols:
        d = d.withColumn(c, F.coalesce(F.col(f"_ff_{c}"), F.col(f"_cf_{c}"), F.col(f"_cb_{c}"), F.lit(default)))
    helpers = [f"_{p}_{c}" for c in cols for p in ("ff", "cf", "cb")]
    return d.drop(BLOCK, POS, *helpers)


def last_known(df: DataFrame, key, order: Sequence[str], col: str, out: str) -> DataFrame:
    """Per key: the last non-NULL value of ``col`` up to and with the row, NULL before the first. Two-level scan."""
    keys = _keys(key)
    d = _blocked(df, key, order)
    past = Window.partitionBy(*keys, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # one row per (key, block)
    summ = d.groupBy(*keys, BLOCK).agg(F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(POS))).alias("_l"))
    names = [f"_key{i}" for i in range(len(keys))]
    summ = summ.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(BLOCK).alias("_b"), F.last("_l", True).over(before).alias("_c"))
    same = F.col(BLOCK) == F.col("_b")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    d = d.withColumn(out, F.last(col, True).over(past)).join(summ, same)
    return d.withColumn(out, F.coalesce(F.col(out), F.col("_c"))).drop("_b", "_c", BLOCK, POS, *names)


def floored_running_total(df: DataFrame, key, order: Sequence[str], change: str, start: Column | str,
                          floor: float, out: str, keep_position: bool = False) -> DataFrame:
    """L_i = max(floor, L_{i-1} + change_i) with L_0 = start, without a row loop.

    With S_i the running sum of ``change``: L_i = S_i + max(start, max_{j<=i}(floor - S_j)).
    S and the running maximum are two-level scans (inside blocks, then across block summaries).
    """
    keys = _keys(key)
    start_col = F.col(start) if isinstance(start, str) else start
    d = _blocked(df, key, order).withColumn("_c", F.coalesce(F.col(change), F.lit(0.0)))
    wb = Window.partitionBy(*keys, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum("_c").over(wb))                       # in-block running sum
    d = d.withColumn("_m", F.max(F.lit(float(floor)) - F.col("_s")).over(wb))   # in-block max(floor - s)
    summ = d.groupBy(*keys, BLOCK).agg(F.sum("_c").alias("_t"), F.max(F.lit(float(floor)) - F.col("_s")).alias("_mb"))
    wk = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_off", F.coalesce(F.sum("_t").over(wk), F.lit(0.0)))
    # max over earlier blocks of (floor - S_j) = max(_mb - _off) of those blocks
    summ = summ.withColumn("_g", F.max(F.col("_mb") - F.col("_off")).over(wk))
    d = d.join(summ.select(*keys, BLOCK, "_off", "_g"), [*keys, BLOCK])
    s_glob = F.col("_off") + F.col("_s")
    inner = F.greatest(start_col, F.col("_m") - F.col("_off"),
                       F.coalesce(F.col("_g"), start_col))
    d = d.withColumn(out, s_glob + inner).drop("_c", "_s", "_m", "_off", "_g", BLOCK)
    return d if keep_position else d.drop(POS)


def position_and_count(df: DataFrame, key, order: Sequence[str], pos: str = "pos", count: str = "n",
                       totals: dict[str, tuple[Column, Callable[[str], Column]]] | None = None) -> DataFrame:
    """1-based position inside the key, the key's row count and further ``totals`` (see ``row_index``); no per-key task.
    Rows without a key are left out."""
    d = row_index(df.dropna(subset=_keys(key)), key, order, pos="_p0", totals={count: (F.count(F.lit(1)), F.sum), **(totals or {})})
    return d.withColumn(pos, F.col("_p0") + 1).drop("_p0")
