"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.session import shared_path

WORD_SPACE = " \t\n\x0b\x0c\r"


_open_scopes: list[list[str]] = []


def scratch(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new folder below the shared checkpoint folder.

    Within ``freed`` it goes when that block ends; with ``outlives`` it
    belongs to the block around it, if there is one.
    """
    path = shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    owners = _open_scopes[:-1] if outlives else _open_scopes
    if owners:
        owners[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def freed(spark: SparkSession):
    """Scratch folders made in the block are deleted at its end; results that others read must outlive it."""
    paths: list[str] = []
    _open_scopes.append(paths)
    try:
        yield
    finally:
        _open_scopes.pop()
        for path in paths:
            discard(spark, path)


def written(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later passes start from the files, so a lost executor costs no more than
    the tasks it was running.
    """
    path = scratch(df.sparkSession, name, outlives)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` followed by the fields of ``ddl``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def id_bucket(column, modulus: int):
    """``crc32(id as text) mod modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def row_chunks(batches, size, most: int):
    """Slices of Arrow batches whose rows' ``size`` (a function of a batch; null counts 0) adds up to ``most`` at most, at least one row.

    After the last batch Arrow gives the memory that it holds unused back.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(size(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    pa.default_memory_pool().release_unused()


def text_chunks(batches, column: str, max_bytes: int = 4 << 20):
    """Slices of Arrow batches with about ``max_bytes`` of ``column`` each, at least one row."""
    import pyarrow.compute as pc

    return row_chunks(batches, lambda batch: pc.binary_length(batch.column(column)), max_bytes)


def utf8(batch, column: str) -> list[bytes]:
    """The column's UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift) over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordCodes(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word):
        code = self[word] = len(self)
        return code

    def encode(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class WordHashes(dict):
    """Word bytes to a 64-bit hash; forgets its entries when ``limit`` are held."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self._hash, self._limit = xxh3_64_intdigest, limit

    def __missing__(self, word):
        if len(self) >= self._limit:
            self.clear()
        h = self[word] = self._hash(word)
        return h

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def arrow_schema(ddl: str):
    """Arrow schema of a flat DDL string, worked out without a session (for tasks)."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def arrow_table(rows: list[tuple], schema):
    """Rows as an Arrow table; ``schema`` is an Arrow schema or a DDL string."""
    import pyarrow as pa

    arrow = arrow_schema(schema) if isinstance(schema, str) else schema
    cols = list(zip(*rows, strict=True)) or [[] for _ in arrow]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
