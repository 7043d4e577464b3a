"""Exact global order without a single-task window.

A window with an ``ORDER BY`` and no ``PARTITION BY`` (or one partition per
model / class) sends every row of the group to one task; Spark's exact
``percentile`` aggregate keeps every distinct value in one final buffer.
Both break at scale.  Two ways round them:

*Radix counting.*  The order-preserving 64-bit image of a double is read digit
by digit, upper digits first.  A pass counts, for each value range that holds
a wanted rank, the next digit of the rows in it: 2^13 counters a range,
whatever the number of rows.  Five passes give exact order statistics; three
give the boundaries of equal buckets.  No row is copied and no sample drawn.

*Buckets.*  Running sums in order are taken bucket by bucket: boundaries from
radix counting (or directly from a uniform hash), applied per row by
``Bucketizer`` (JVM binary search); per-bucket totals and their running
offsets; running sums inside each bucket only, plus the offset.  Every task is
bounded by one bucket's rows, and the bucket count grows with the input
(``rows_per_bucket``) without a cap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..session import materialize
from .joins import broadcast_if_bounded

ROWS_PER_BUCKET = 2_000_000
MIN_BUCKETS = 16
# digits of the 64-bit image, from the top, and value ranges counted in one pass
DIGITS = (12, 13, 13, 13, 13)
RANGES = 512


def bucket_count(n: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return int(max(MIN_BUCKETS, math.ceil(n / max(1, rows_per_bucket))))


def image(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 counts as 0.0)."""
    u = (np.asarray(x, dtype=np.float64) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(u & top, ~u, u | top)


def double(key: int) -> float:
    """The double behind an ``image``."""
    u = key ^ (1 << 63) if key >> 63 else ~key & (2**64 - 1)
    return float(np.uint64(u).view(np.float64))


def _count_digits(df: DataFrame, cols: Sequence[str], wanted: Sequence[tuple[int, int, int]], level: int) -> dict:
    """(group, column, prefix) -> counts of the digit after the prefix, one pass over ``df`` for ``RANGES`` of them."""
    import pyarrow as pa

    above, bits = sum(DIGITS[:level]), DIGITS[level]
    shift, low = np.uint64(64 - above - bits), np.uint64((1 << bits) - 1)
    out = {}
    for first in range(0, len(wanted), RANGES):
        here = sorted(wanted[first : first + RANGES])
        by_slot: dict = {}
        for i, (g, c, prefix) in enumerate(here):
            by_slot.setdefault((g, c), ([], []))
            by_slot[(g, c)][0].append(prefix)
            by_slot[(g, c)][1].append(i)

        def run(batches, by_slot=by_slot, n=len(here)):
            counts = np.zeros((n, 1 << bits), dtype=np.int64)
            for batch in batches:
                group = batch.column(0).to_numpy(zero_copy_only=False)
                values = [batch.column(1 + c).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(len(cols))]
                for (g, c), (prefixes, places) in by_slot.items():
                    x = values[c][(group == g) & ~np.isnan(values[c])]
                    if not len(x):
                        continue
                    key = image(x)
                    head = key >> np.uint64(64 - above) if above else np.zeros(len(key), dtype=np.uint64)
                    known = np.array(prefixes, dtype=np.uint64)
                    at = np.minimum(np.searchsorted(known, head), len(known) - 1)
                    mine = known[at] == head
                    flat = np.array(places)[at[mine]] * (1 << bits) + ((key[mine] >> shift) & low).astype(np.int64)
                    cell, n_rows = np.unique(flat, return_counts=True)
                    counts.ravel()[cell] += n_rows
            slot, digit = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(digit), pa.array(counts[slot, digit])], names=["slot", "digit", "n"])

        counted = df.select("_g", *cols).mapInArrow(run, "slot long, digit long, n long").groupBy("slot", "digit").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros((len(here), 1 << bits), dtype=np.int64)
        table[counted.column("slot").to_numpy(), counted.column("digit").to_numpy()] = counted.column("n").to_numpy()
        out.update(zip(here, table))
    return out


def order_statistics(df: DataFrame, cols: Sequence[str], ranks, groups: int = 1, levels: int = len(DIGITS)) -> dict:
    """(group, column) -> (number of values, {rank: value}) by radix counting.

    ``df`` has ``_g`` (group number) and the columns as doubles; nulls and NaN
    are skipped.  ``ranks(n)`` lists the wanted ranks (from 0) among n values.
    With fewer ``levels`` a value is the least double of its digits' range.
    """
    open_ = {(g, c): {0: None} for g in range(groups) for c in range(len(cols))}
    sizes: dict = {}
    for level in range(levels):
        wanted = [(g, c, prefix) for (g, c), prefixes in open_.items() for prefix in prefixes]
        counts = _count_digits(df, cols, wanted, level)
        for (g, c), prefixes in open_.items():
            deeper: dict = {}
            for prefix, own in prefixes.items():
                ends = np.cumsum(counts[(g, c, prefix)])
                if own is None:
                    sizes[(g, c)] = int(ends[-1])
                    own = {k: k for k in ranks(int(ends[-1]))} if ends[-1] else {}
                for rank, left in own.items():
                    digit = int(np.searchsorted(ends, left, side="right"))
                    before = int(ends[digit - 1]) if digit else 0
                    deeper.setdefault((prefix << DIGITS[level]) | digit, {})[rank] = left - before
            open_[(g, c)] = deeper
    rest = 64 - sum(DIGITS[:levels])
    return {slot: (sizes[slot], {rank: double(prefix << rest) for prefix, own in prefixes.items() for rank in own}) for slot, prefixes in open_.items()}


def bucket_splits(df: DataFrame, cols: Sequence[str], buckets: int) -> list[list[float]]:
    """Strictly increasing Bucketizer splits per column that cut the rows into about equal buckets."""
    rows = df.select(F.lit(0).alias("_g"), *[F.col(c).cast("double").alias(c) for c in cols])
    found = order_statistics(rows, cols, lambda n: sorted({k * n // buckets for k in range(1, buckets)} & set(range(n))), levels=3)
    out = []
    for c in range(len(cols)):
        inner = sorted({v for v in found[(0, c)][1].values() if math.isfinite(v)})
        out.append([-math.inf, *inner, math.inf])
    return out


def bucketize(df: DataFrame, cols: Sequence[str], out_cols: Sequence[str], splits: list[list[float]]) -> DataFrame:
    if len(cols) == 1:
        b = Bucketizer(splits=splits[0], inputCol=cols[0], outputCol=out_cols[0], handleInvalid="keep")
    else:
        b = Bucketizer(splitsArray=splits, inputCols=list(cols), outputCols=list(out_cols), handleInvalid="keep")
    return b.transform(df)


def hash_bucket(h: Column, buckets: int, span: float = 4294967296.0) -> Column:
    """Bucket of a uniform hash in [0, span): boundaries need no sampling pass."""
    return F.floor(h.cast("double") * F.lit(float(buckets)) / F.lit(span)).cast("int")


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    values: Sequence[str],
    descending: bool = False,
    prefix: str = "cum_",
    nulls: bool = False,
) -> DataFrame:
    """Running sums of ``values`` in ``order`` within ``by``, bucket by bucket.

    ``bucket`` must be monotone in ``order`` (ascending, or descending when
    ``descending``).  Adds ``prefix + v`` for every value: the inclusive
    running sum over the whole group, identical to a one-partition window.
    Rows with a null in ``by`` or ``bucket`` are left out unless ``nulls``.
    """
    by = list(by)
    totals = df.groupBy(*by, bucket).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    border = F.col(bucket).desc() if descending else F.col(bucket).asc_nulls_last()
    w = Window.partitionBy(*by).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*by, bucket)], *[F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    wl = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(offsets, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) if nulls else F.col(c) == F.col(f"_k_{c}") for c in (*by, bucket)])
    return joined.select(
        *df.columns, *[(F.col(f"_o_{v}") + F.sum(v).over(wl)).alias(prefix + v) for v in values]
    )


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    name_col: str = "feature",
    materialized: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy's default, DuckDB ``quantile_cont``).

    Returns ``(by..., feature, prob, value)``.  Nulls and NaN are skipped; a
    group and column without a value has no row.  The groups of ``by`` come to
    the driver and are counted ``RANGES`` ranges a pass.
    """
    by, cols = list(by), list(cols)
    vals = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    if not materialized:
        vals = materialize(vals)  # five passes follow: read the input once
    spark, groups = df.sparkSession, [()]
    if by:
        named = vals.select(*by).distinct().collect()
        groups = [tuple(r) for r in named]
        codes = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], StructType([*[StructField(f"_k{j}", vals.schema[b].dataType) for j, b in enumerate(by)], StructField("_g", LongType())]))
        same = [vals[b].eqNullSafe(codes[f"_k{j}"]) for j, b in enumerate(by)]
        coded = materialize(vals.join(broadcast_if_bounded(codes, 100_000), same).select("_g", *cols))
    else:
        coded = vals.select(F.lit(0).cast("long").alias("_g"), *cols)

    def around(n: int) -> list[int]:
        return sorted({k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})

    rows = []
    for (g, c), (n, value) in order_statistics(coded, cols, around, len(groups)).items():
        for p in probs if n else ():
            at = p * (n - 1)
            low, high = value[math.floor(at)], value[math.ceil(at)]
            rows.append((*groups[g], cols[c], float(p), low + (high - low) * (at - math.floor(at))))
    schema = StructType([*[vals.schema[b] for b in by], StructField(name_col, StringType()), StructField("prob", DoubleType()), StructField("value", DoubleType())])
    return spark.createDataFrame(rows, schema)
