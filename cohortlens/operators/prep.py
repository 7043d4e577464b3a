"""Preparation: deterministic splits, exact stratified split, folds, scaling.

Splits are functions of an md5 hash of the row key, so they do not depend
on partitioning or on the engine.  An exact split finds the hash it ends at by
counting its digits.  Stratified splits and balanced folds rank every row
within its class; they use the bucketed running sums of ``ordered`` with buckets cut directly on the
uniform hash (no sampling pass), so no task ever holds a whole class.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.derive import is_test
from ..session import materialize
from .ordered import bucket_count, hash_bucket, running_totals
from .stats import mean_pop_std


def hash_split(df: DataFrame, h: str = "h_split", alias: str = "part") -> DataFrame:
    """``test`` for one row in ``TEST_MODULUS`` (by hash), else ``train``."""
    return df.withColumn(alias, F.when(is_test(h), F.lit("test")).otherwise(F.lit("train")))


def class_ranks(
    df: DataFrame,
    label: str = C.LABEL,
    h: str = "h_split",
    tie_breakers: Sequence[str] = (*C.KEYS, *C.FEATURES),
    alias: str = "rank",
    nulls: bool = False,
) -> tuple[DataFrame, dict]:
    """1-based rank of each row within its class, ordered by (hash, tie-breakers).

    Returns the ranked frame and the class sizes (one number per class, the
    only values brought to the driver).
    """
    # read three times (class sizes, bucket totals, ranks): compute it once
    df = materialize(df)
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    buckets = bucket_count(max(sizes.values(), default=0))
    staged = df.withColumn("_b", hash_bucket(F.col(h), buckets)).withColumn("_one", F.lit(1))
    ranked = running_totals(staged, [label], "_b", [F.col(h).asc_nulls_last(), *[F.col(c) for c in tie_breakers]], ["_one"], nulls=nulls)
    return ranked.withColumnRenamed("cum__one", alias).drop("_b", "_one"), sizes


#: Bits of the hash that one counting pass looks at: 2^16 counters a class.
DIGIT_BITS = 16


def cut_hashes(keys: DataFrame, share: Fraction, cls: str, h: str) -> dict:
    """Class -> (cut, ties wanted, ties there): the lowest ``ceil(share n)`` hashes of a class end at ``cut``.

    Two aggregates: rows by the hash's upper digit, then by the lower digit
    among the rows of the one upper digit that holds the cut.
    """
    digit = F.shiftright(F.col(h), DIGIT_BITS)
    found: dict = {}
    for r in keys.where(F.col(h).isNotNull()).groupBy(cls, digit.alias("d")).count().collect():
        found.setdefault(r[0], {})[r[1]] = r[2]
    uppers = {}
    for c, counts in found.items():
        left = math.ceil(share * sum(counts.values()))
        for d in sorted(counts):
            if left <= counts[d]:
                uppers[c] = (d, left)
                break
            left -= counts[d]
    here = functools.reduce(lambda a, b: a | b, [F.col(cls).eqNullSafe(F.lit(c)) & (digit == d) for c, (d, _) in uppers.items()], F.lit(False))
    lower: dict = {}
    for r in keys.where(here).groupBy(cls, F.col(h).alias("h")).count().collect():
        lower.setdefault(r[0], {})[r[1]] = r[2]
    cuts = {}
    for c, counts in lower.items():
        left = uppers[c][1]
        for value in sorted(counts):
            if left <= counts[value]:
                cuts[c] = (value, left, counts[value])
                break
            left -= counts[value]
    return cuts


def exact_split(
    df: DataFrame,
    test_share: float | Fraction = 0.2,
    label: str | None = None,
    h: str = "h_split",
    tie_breakers: Sequence[str] = (*C.KEYS, *C.FEATURES),
) -> DataFrame:
    """Exactly ``ceil(test_share * n)`` test rows, of the table or of each class of ``label``: those with the lowest hashes.

    The cut is found by counting digits of the hash, so rows are filtered,
    not ranked; only where several rows share the cut's hash and some of them
    are wanted are these few ranked by ``tie_breakers``.  The share is taken
    as the exact decimal it is written as (0.2 = 1/5).  Rows without a hash
    are training rows.
    """
    share = test_share if isinstance(test_share, Fraction) else Fraction(str(test_share))
    cls = F.lit(0) if label is None else F.col(label)
    cuts = cut_hashes(materialize(df.select(cls.alias("_cls"), F.col(h).alias("_h"))), share, "_cls", "_h")
    test, tied = F.lit(False), F.lit(False)
    for c, (cut, wanted, there) in cuts.items():
        own = cls.eqNullSafe(F.lit(c))
        test = test | (own & (F.col(h) < cut if wanted < there else F.col(h) <= cut))
        tied = tied | (own & (F.col(h) == cut)) if wanted < there else tied
    part = lambda cond: F.when(F.coalesce(cond, F.lit(False)), F.lit("test")).otherwise(F.lit("train"))
    if all(wanted == there for _, wanted, there in cuts.values()):
        return df.withColumn("part", part(test))
    tied = F.coalesce(tied, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(*tie_breakers))
    first = functools.reduce(lambda a, b: a | b, [cls.eqNullSafe(F.lit(c)) & (F.col("_rank") <= wanted) for c, (_, wanted, _) in cuts.items()])
    ranked = df.where(tied).withColumn("_rank", rank).withColumn("part", part(first)).drop("_rank")
    return df.where(~tied).withColumn("part", part(test)).unionByName(ranked)


def stratified_split(df: DataFrame, test_share: float | Fraction = 0.2, label: str = C.LABEL, **kw) -> DataFrame:
    """Every row's ``rank`` within its class, and exactly ``ceil(test_share * n_class)`` test rows a class: the lowest ranks.

    The share is taken as the exact decimal it is written as (0.2 = 1/5), so
    the cut does not depend on binary rounding of ``0.2 * n``.
    """
    share = test_share if isinstance(test_share, Fraction) else Fraction(str(test_share))
    ranked, sizes = class_ranks(df, label, nulls=True, **kw)
    test = functools.reduce(lambda a, b: a | b, [F.col(label).eqNullSafe(F.lit(c)) & (F.col("rank") <= math.ceil(share * n)) for c, n in sizes.items()], F.lit(False))
    return ranked.withColumn("part", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def fold_column(df: DataFrame, folds: int = C.N_FOLDS, label: str = C.LABEL, alias: str = "fold", **kw) -> DataFrame:
    """Stratified fold id: class rank modulo ``folds`` (balanced within each class)."""
    ranked, _ = class_ranks(df, label, **kw)
    return ranked.withColumn(alias, (F.col("rank") % F.lit(folds)).cast("int"))


def with_row_id(df: DataFrame, key: Sequence[str], alias: str = "row_id") -> DataFrame:
    """``df``, checkpointed, with a unique 64-bit id that depends on the row alone.

    The id is a hash of ``key`` and, among rows with an equal key, of their
    number; should two hashes ever meet, all are drawn anew.  Rows with an
    equal key should be equal in every column that matters.
    """
    again = Window.partitionBy(*key).orderBy(*key)
    counted = df.withColumn("_again", F.row_number().over(again))
    for salt in range(8):
        out = materialize(counted.withColumn(alias, F.xxhash64(F.lit(salt), *key, "_again")).drop("_again"))
        n, distinct = out.agg(F.count(F.lit(1)), F.count_distinct(alias)).first()
        if n == distinct:
            return out
    raise RuntimeError("no unique row ids")


# ------------------------------------------------------------------ scaler
class _ScalerParams(HasInputCols, HasOutputCols):
    pass


class PopStandardScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Centre and divide by the *population* std (a constant column scales by 1).

    Spark's ``StandardScaler`` divides by the sample std and does not centre
    by default; this one matches the usual in-memory convention.  Fitting is
    one aggregation pass.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PopStandardScalerModel":
        cols = self.getInputCols()
        stats = {r["feature"]: (r["mean"], r["std"]) for r in mean_pop_std(dataset, cols).collect()}
        model = PopStandardScalerModel(
            inputCols=cols,
            outputCols=self.getOutputCols(),
            means=[float(stats[c][0]) for c in cols],
            stds=[float(stats[c][1]) for c in cols],
        )
        return model


class PopStandardScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "per-column means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "per-column population stds", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        exprs = {}
        for c, o, m, s in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.means), self.getOrDefault(self.stds)):
            scale = s if s and s > 0 else 1.0
            exprs[o] = (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(scale))
        return dataset.withColumns(exprs)


def one_hot_stages(col: str, out: str | None = None) -> list:
    """``StringIndexer`` + ``OneHotEncoder`` that drop the alphabetically *first* level.

    ``alphabetDesc`` gives the first level the last index and ``dropLast``
    drops it, matching the drop-first convention (Spark's defaults would drop
    the least frequent level instead).
    """
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    idx = f"_{col}_idx"
    return [
        StringIndexer(inputCol=col, outputCol=idx, stringOrderType="alphabetDesc", handleInvalid="error"),
        OneHotEncoder(inputCols=[idx], outputCols=[out or f"{col}_vec"], dropLast=True),
    ]
