"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
No text leaves its place unless its fingerprint was met twice:

1. *Fingerprints.*  A task puts equal texts of a bounded window together (by
   their bytes) and writes each such class once: digest, text, ids.  Beside
   them lies one row a *part* (a task's classes, at most ``PART_KEYS``) with
   the 64-bit hashes of its classes.  The table is bucketed by part.
2. *Exchange.*  With the number of classes known, hashes are cut to
   ``log2(classes) + EXTRA_BITS`` bits.  A part sends its sorted, distinct
   fingerprints to the owners of their ranges, as Golomb-coded gaps (the
   power-of-two case).  An owner answers each message with two bitmaps:
   met in several parts, and met in more than ``HOT_PARTS`` parts.
3. *Suspects.*  A part turns the answers into bits by class, which meet the
   classes without an exchange of the stored side.  Classes with a clear bit
   are whole groups already.
4. *Verification.*  Suspect texts alone are shuffled and grouped by their
   bytes, so a fingerprint met twice by chance parts again.  Hot ones are
   grouped in ``SALTS`` shares first.  A verdict goes back under its digest,
   which here only names a group that was told apart by bytes.

Of equal texts the row with the largest id stays; null ids rank below all
others, and among rows with that same id the first one read stays.  An empty
table gives an empty result.  Only the two named columns are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from cohortlens.llm.blocks import bucketed
from cohortlens.llm.common import arrow_schema, text_chunks, utf8, written

#: Classes of a part at most; a task with more makes several parts.
PART_KEYS = 1 << 20
#: Bytes of text (and 64 for each row) that a task holds to put equal texts together.
WINDOW_BYTES = 32 << 20
#: Fingerprints of an owner on average, at most; and the least number of owners, for small inputs.
OWNER_KEYS = 1 << 22
LEAST_OWNERS = 16
#: Bits of a fingerprint beyond the logarithm of their number: about one text in 2^20 is a suspect by chance.
EXTRA_BITS = 20
#: A fingerprint from more parts than this is hot: its texts are grouped, and its verdicts sent, in so many shares.
HOT_PARTS = 64
SALTS = 64

MESSAGE = "owner bigint, part bigint, n bigint, code binary"
REPLY = "part bigint, owner bigint, n bigint, dup binary, hot binary"
BITS = "part bigint, dup array<bigint>, hot array<bigint>"


# ------------------------------------------------------------------ Golomb code
def golomb(gaps: np.ndarray) -> bytes:
    """Gaps (unsigned) as a Golomb code with a power of two as its parameter.

    One byte for the parameter's exponent, then all quotients in unary, then
    all remainders in ``exponent`` bits each.
    """
    k = max(0, int(math.log2(max(1.0, float(gaps.astype(np.float64).mean()) * math.log(2)))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def gaps_of(code: bytes, n: int) -> np.ndarray:
    """The ``n`` gaps behind a Golomb code."""
    k = code[0]
    low_bytes = (n * k + 7) // 8
    body = np.frombuffer(code, dtype=np.uint8)[1:]
    unary = np.unpackbits(body[: len(body) - low_bytes])
    ends = np.flatnonzero(unary)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(body[len(body) - low_bytes :], count=n * k).reshape(n, k).astype(np.uint64) if k else np.zeros((n, 0), dtype=np.uint64)
    return (quotient.astype(np.uint64) << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _cut(fps: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(fps, dtype="<u8") >> np.uint64(64 - bits)


def _owner_starts(bits: int, owners: int) -> np.ndarray:
    """The first fingerprint of each owner's range."""
    return np.array([(i << bits) // owners for i in range(owners)], dtype=np.uint64)


def _table(rows: list[tuple], ddl: str):
    import pyarrow as pa

    schema = arrow_schema(ddl)
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


# ------------------------------------------------------------------ the steps
def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored classes (part, cls, sha, text, ids) and the parts' rows (part, fps), bucketed by part."""
    import pyarrow as pa

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = StructType(
        [StructField("part", LongType()), StructField("cls", IntegerType()), StructField("sha", BinaryType()), StructField("text", BinaryType()), StructField("ids", ArrayType(picked.schema["doc_id"].dataType)), StructField("fps", BinaryType())]
    )
    window_bytes, part_keys = WINDOW_BYTES, PART_KEYS

    def run(batches):
        from hashlib import sha256

        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema
        from xxhash import xxh3_64_intdigest

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId() << 20
        window, held, fps = {}, 0, []

        def rows(cells):
            columns = list(zip(*cells, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        def flush():
            cells, size = [], 0
            for text, ids in window.items():
                ids.sort(key=lambda x: (x is not None, x), reverse=True)
                cells.append((part, len(fps), sha256(text).digest(), text, ids, None))
                fps.append(xxh3_64_intdigest(text))
                size += len(text) + 16 * len(ids)
                if size > 4 << 20:
                    yield rows(cells)
                    cells, size = [], 0
            if cells:
                yield rows(cells)

        def close():
            yield rows([(part, None, None, None, None, np.array(fps, dtype="<u8").tobytes())])

        for batch in text_chunks(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                ids = window.setdefault(text.lower(), [])
                held += 64 + (0 if ids else len(text))
                ids.append(doc)
                if held >= window_bytes or len(fps) + len(window) >= part_keys:
                    yield from flush()
                    window, held = {}, 0
                    if len(fps) >= part_keys:
                        yield from close()
                        part, fps = part + 1, []
        if window:
            yield from flush()
        if fps:
            yield from close()

    return bucketed(picked.mapInArrow(run, schema), "part", "fingerprints")


def _messages(parts: DataFrame, bits: int, owners: int) -> DataFrame:
    def run(batches):
        starts = _owner_starts(bits, owners)
        for batch in batches:
            for part, fps in zip(batch.column("part").to_pylist(), batch.column("fps").to_pylist(), strict=True):
                keys = np.unique(_cut(fps, bits))
                cuts = np.append(np.searchsorted(keys, starts), len(keys))
                rows = []
                for owner in np.flatnonzero(np.diff(cuts)):
                    own = keys[cuts[owner] : cuts[owner + 1]]
                    rows.append((int(owner), part, len(own), golomb(np.diff(own, prepend=starts[owner]))))
                yield from _table(rows, MESSAGE).to_batches()

    return parts.select("part", "fps").mapInArrow(run, MESSAGE)


def _answers(messages: DataFrame, hot_parts: int) -> DataFrame:
    """For each message a bit by fingerprint: in several parts, in more than ``hot_parts``."""

    def run(group):
        ns = group.column("n").to_numpy()
        keys = np.concatenate([np.cumsum(gaps_of(code, n), dtype=np.uint64) for code, n in zip(group.column("code").to_pylist(), ns.tolist(), strict=True)])
        _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        met = count[place]
        ends = np.cumsum(ns)
        rows = []
        for part, owner, n, end in zip(group.column("part").to_pylist(), group.column("owner").to_pylist(), ns.tolist(), ends.tolist(), strict=True):
            own = met[end - n : end]
            rows.append((part, owner, n, np.packbits(own > 1).tobytes(), np.packbits(own > hot_parts).tobytes()))
        return _table(rows, REPLY)

    return messages.groupBy("owner").applyInArrow(run, REPLY)


def _words(flags: np.ndarray) -> list[int]:
    """Flags as 64-bit words, lowest bit first."""
    return np.packbits(np.pad(flags, (0, -len(flags) % 64)), bitorder="little").view("<i8").tolist()


def _bits_by_class(parts: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """The answers of all owners, put together in each part as bits by class number."""

    def run(own, replies):
        order = np.argsort(replies.column("owner").to_numpy(), kind="stable")
        rows = []
        for part, fps in zip(own.column("part").to_pylist(), own.column("fps").to_pylist(), strict=True):
            _, place, count = np.unique(_cut(fps, bits), return_inverse=True, return_counts=True)
            ns = replies.column("n").to_numpy()
            flags = {}
            for name in ("dup", "hot"):
                cells = replies.column(name).to_pylist()
                flags[name] = np.concatenate([np.unpackbits(np.frombuffer(cells[i], dtype=np.uint8), count=int(ns[i])) for i in order]).astype(bool)
            rows.append((part, _words((flags["dup"] | (count > 1))[place]), _words(flags["hot"][place])))
        return _table(rows, BITS)

    return parts.select("part", "fps").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, BITS)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    store = classes(docs, id_col, text_col)
    parts = store.where(F.col("fps").isNotNull())
    total = parts.agg(F.sum(F.octet_length("fps") / 8)).first()[0] or 0
    owners = max(math.ceil(total / OWNER_KEYS), LEAST_OWNERS)
    bits = min(64, max(1, math.ceil(math.log2(max(2, total))) + EXTRA_BITS))
    answers = _answers(_messages(parts, bits, owners), HOT_PARTS)
    flags = written(_bits_by_class(parts, answers, bits), "suspect-bits")

    bit = lambda name: F.expr(f"getbit({name}[shiftright(cls, 6)], cls & 63) = 1")
    own = store.where(F.col("fps").isNull()).drop("fps").join(flags.hint("shuffle_hash"), "part")
    own = own.withColumns({"suspect": bit("dup"), "salt": F.when(bit("hot"), F.pmod(F.xxhash64("part", "cls"), F.lit(SALTS))).otherwise(F.lit(-1))}).drop("dup", "hot")

    single = own.where(~F.col("suspect")).select("sha", "ids", F.posexplode("ids").alias("at", "doc_id"))
    single = single.select("doc_id", F.col("ids")[0].alias("keep_id"), F.size("ids").cast("long").alias("group_size"), (F.col("at") == 0).alias("kept"), "sha")

    suspects = own.where("suspect")
    best = F.max(F.struct(F.col("ids")[0].alias("id"), (-F.col("part")).alias("part"), (-F.col("cls")).alias("cls"))).alias("best")
    share = suspects.groupBy("sha", "salt", "text").agg(best, F.sum(F.size("ids")).alias("size"))
    hot = F.col("salt") >= 0
    whole = share.groupBy("sha", F.when(hot, F.col("text")).alias("text"), hot.alias("hot")).agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).otherwise(F.array(F.lit(-1).cast("long")))
    verdict = whole.select("sha", F.explode(salts).alias("salt"), "best", "size")
    again = suspects.select("sha", "salt", "part", "cls", "ids").join(verdict, ["sha", "salt"])
    first = (F.col("best.part") == -F.col("part")) & (F.col("best.cls") == -F.col("cls"))
    again = again.select("sha", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), first.alias("first"), F.posexplode("ids").alias("at", "doc_id"))
    again = again.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("at") == 0)).alias("kept"), "sha")
    out = single.unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
