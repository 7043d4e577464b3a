"""Documents as blocks of word codes, kept where later passes find them without a shuffle.

A block is a bounded run of documents of one input partition: its distinct
words once, and each document as numbers of those words.  Blocks lie in a
table that is bucketed by block number, so what a pass sends back to a block
is shuffled alone; the block itself stays where it is.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from cohortlens.llm.common import WordCodes, scratch, text_chunks, utf8

#: Words in a block; a longer document is a block of its own.
BLOCK_WORDS = 1 << 20


@dataclass
class Block:
    """One block: ids and flags by document, words by document, codes by word place, distinct words."""

    ids: list
    flags: list[bool]
    sizes: np.ndarray
    codes: np.ndarray
    words: list[bytes]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _pack(array: np.ndarray) -> bytes:
    return zlib.compress(array.tobytes(), 1)


def unpack(table) -> Block:
    """The block in the first row of an Arrow table."""
    row = {name: table.column(name)[0].as_py() for name in ("ids", "flags", "sizes", "codes", "words")}
    words = zlib.decompress(row["words"]).split()
    return Block(row["ids"], row["flags"], np.frombuffer(row["sizes"], dtype="<i4").astype(np.int64), np.frombuffer(zlib.decompress(row["codes"]), dtype="<u4"), words)


def encode(docs: DataFrame, flag, lower: bool, name: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text), written once; ``flag`` is a Boolean column carried for each document.

    Null text has no words.  ``lower`` puts A-Z into lower case.
    """
    import pyarrow as pa

    picked = docs.select("doc_id", "text", F.coalesce(flag, F.lit(False)).alias("flag"))
    id_type = picked.schema["doc_id"].dataType
    schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(id_type)), StructField("flags", ArrayType(BooleanType())), *(StructField(c, BinaryType()) for c in ("sizes", "codes", "words"))])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, first = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        ids, flags, sizes, codes, own, held, made = [], [], [], [], WordCodes(), 0, 0

        def row():
            flat = np.concatenate(codes).astype("<u4") if codes else np.zeros(0, dtype="<u4")
            cells = [first + made, ids, flags, np.array(sizes, dtype="<i4").tobytes(), _pack(flat), zlib.compress(b" ".join(own), 1)]
            return pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

        for batch in text_chunks(batches, "text"):
            texts = utf8(batch, "text")
            for doc, flagged, text in zip(batch.column("doc_id").to_pylist(), batch.column("flag").to_pylist(), texts, strict=True):
                words = (text.lower() if lower else text).split()
                if ids and held + len(words) > block_words:
                    yield row()
                    ids, flags, sizes, codes, own, held, made = [], [], [], [], WordCodes(), 0, made + 1
                ids.append(doc)
                flags.append(flagged)
                sizes.append(len(words))
                codes.append(own.encode(words).astype("<u4"))
                held += len(words)
        if ids:
            yield row()

    return bucketed(picked.mapInArrow(run, schema), "block", name)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written in the shared folder as a table bucketed by ``key``."""
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).format("parquet").option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)
