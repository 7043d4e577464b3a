"""Line dedup over levelled sorted runs of line hashes.

The store is a set of runs in the shared folder: tables of (hash, number of
documents), bucketed and sorted by hash, and no two runs hold the same key.
Every new batch is reduced to its own keys and merge-anti-joined with the
stored runs, which lie in the order of the join and are not shuffled again.
What no run knows becomes the batch's own run of level 0; the counts of known
keys are kept as increments.  When a level holds ``fanout`` runs they are
merged into one run of the next level, so a batch meets few runs and each key
is rewritten once a level.  A key's documents are those of its run and of its
increments together.

A line's key is the line without ASCII white space at both ends, in ASCII
lower case; its hash has 128 bits.  Keys of at least ``min_chars`` code
points that ``min_docs`` or more documents hold lose all their lines.

Rows: null or empty text is one empty line and stays; a document whose lines
all go keeps an empty text.  A key counts once for each row that holds it, so
repeated rows count each.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import freed, scratch, text_chunks, utf8, with_fields, written

MIN_DOCS, MIN_CHARS = 10, 1
BATCHES, FANOUT = 4, 2
#: Frequent keys that are sent to every task (about 15 MB there); more of them meet the documents by a join.
SEND_AT_MOST = 1 << 17
#: Bytes of text that a task takes at a time, and keys that it counts at a time.
CHUNK, COUNTED = 1 << 20, 200_000
_EDGE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_EDGE).lower()


def _hash(key: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(key)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def line_counts(docs: DataFrame, batch: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(batch, hash, documents that hold the key), summed within each task."""
    import pyarrow as pa

    picked = docs.select(F.col(batch).alias("batch"), "text")

    def run(batches):
        held: dict[tuple[int, bytes], int] = {}

        def flush():
            if held:
                b, h = zip(*held, strict=True)
                out = pa.RecordBatch.from_arrays([pa.array(b, type=pa.int32()), pa.array(h, type=pa.binary()), pa.array(list(held.values()), type=pa.int64())], names=["batch", "hash", "docs"])
                held.clear()
                yield out

        for chunk in text_chunks(batches, "text", CHUNK):
            for b, text in zip(chunk.column("batch").to_pylist(), utf8(chunk, "text"), strict=True):
                for key in {k for line in text.split(b"\n") if _long_enough(k := line_key(line), min_chars)}:
                    at = (b, _hash(key))
                    held[at] = held.get(at, 0) + 1
            if len(held) > COUNTED:
                yield from flush()
        yield from flush()

    return picked.select(F.col("batch").cast("int"), "text").mapInArrow(run, "batch int, hash binary, docs bigint")


@dataclass
class LineRuns:
    """The levelled runs and the increments: (level, table) of each run, oldest first."""

    spark: SparkSession
    root: str
    fanout: int = FANOUT
    runs: list[tuple[int, str]] = field(default_factory=list)
    increments: list[str] = field(default_factory=list)
    name: str = field(default_factory=lambda: f"llm_lines_{uuid.uuid4().hex[:12]}")
    made: int = 0

    SCHEMA = "hash binary, docs bigint"

    @property
    def buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, kind: str) -> str:
        """A table of ``rows`` with one file a bucket, sorted by hash."""
        table = f"{self.name}_{self.made}"
        self.made += 1
        dealt = rows.repartition(self.buckets, "hash").sortWithinPartitions("hash")
        dealt.write.bucketBy(self.buckets, "hash").sortBy("hash").format("parquet").option("path", f"{self.root}/{kind}-{self.made}").saveAsTable(table)
        return table

    def _all(self, tables: list[str]) -> DataFrame:
        frames = [self.spark.table(t) for t in tables]
        return functools.reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], self.SCHEMA)

    def stored(self) -> DataFrame:
        """All runs' rows, one for each key."""
        return self._all([t for _, t in self.runs])

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (hash, docs) whose key no run holds: merge anti joins, one a run."""
        for _, table in self.runs:
            batch = batch.hint("merge").join(self.spark.table(table).select("hash").hint("merge"), "hash", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> int:
        """Take in the batch's rows (hash, docs): new keys as a run of level 0, known ones as increments; the number of new keys."""
        own = self.spark.table(self._write(batch.groupBy("hash").agg(F.sum("docs").alias("docs")), "batch"))
        run = self._write(self.fresh(own), "run")
        if self.runs:
            known = own.hint("merge").join(self.spark.table(run).select("hash").hint("merge"), "hash", "left_anti")
            self.increments.append(self._write(known, "increment"))
        self.runs.append((0, run))
        self._compact()
        return self.spark.table(run).count()

    def _compact(self) -> None:
        level = 0
        while sum(at == level for at, _ in self.runs) >= self.fanout:
            full = [t for at, t in self.runs if at == level]
            merged = self._write(self._all(full), "run")
            self.runs = [(level + 1, merged) if t == full[-1] else (at, t) for at, t in self.runs if t not in full[:-1]]
            level += 1

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Keys that ``min_docs`` or more documents hold, by their run and their increments."""
        more = self._all(self.increments).groupBy("hash").agg(F.sum("docs").alias("more"))
        docs = (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs")
        return self.stored().join(more, "hash", "left").select("hash", docs).where(F.col("docs") >= min_docs)

    def forget(self) -> None:
        """Take the tables out of the catalog."""
        for i in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i}")
        self.runs, self.increments = [], []


def ingest(docs: DataFrame, batch: str, store: LineRuns, min_chars: int = MIN_CHARS) -> list[int]:
    """Add the batches of ``docs`` (an integer column names them) in order; returns the number of new keys of each."""
    counts = written(line_counts(docs, batch, min_chars), "line-counts")
    batches = sorted(r[0] for r in counts.select("batch").distinct().collect())
    return [store.add(counts.where(F.col("batch") == b)) for b in batches]


def drop_lines(text: bytes, frequent, min_chars: int = MIN_CHARS) -> tuple[int, int, bytes]:
    """Lines, dropped lines and the kept lines joined."""
    lines = text.split(b"\n")
    kept = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and _hash(k) in frequent)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def apply(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS, send_at_most: int = SEND_AT_MOST, prefix: str = "") -> DataFrame:
    """``docs`` with the columns ``n_lines``, ``n_dropped`` and ``kept_text`` (under ``prefix``).

    ``frequent`` (hash) is a written table.  A frequent set of up to ``send_at_most`` keys (16 bytes each) goes to
    every task.  A larger one is joined: texts are cut to line hashes, those
    that are frequent return to their text by its digest.
    """
    import pyarrow as pa

    names = [f"{prefix}{x}" for x in ("n_lines", "n_dropped", "kept_text")]
    ddl = f"`{names[0]}` bigint, `{names[1]}` bigint, `{names[2]}` string"
    small = frequent.count() <= send_at_most
    held = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in frequent.collect())) if small else None
    own = f"{prefix}_frequent_lines"

    def run(batches):
        for batch in text_chunks(batches, "text", CHUNK):
            sets = [held.value] * batch.num_rows if small else [set(x or ()) for x in batch.column(own).to_pylist()]
            rows = [drop_lines(t, s, min_chars) for t, s in zip(utf8(batch, "text"), sets, strict=True)]
            n, dropped, kept = zip(*rows, strict=True)
            cols, fields = (batch.columns, batch.schema.names) if small else zip(*[(c, f) for c, f in zip(batch.columns, batch.schema.names, strict=True) if f != own], strict=True)
            arrays = [pa.array(n, type=pa.int64()), pa.array(dropped, type=pa.int64()), pa.array([k.decode() for k in kept])]
            yield pa.RecordBatch.from_arrays([*cols, *arrays], names=[*fields, *names])

    if small:
        return docs.mapInArrow(run, with_fields(docs, ddl))
    key = f"{prefix}_text_key"
    texts = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias(key), "text")

    def hashes(batches):
        for batch in text_chunks(batches, "text", CHUNK):
            for k, text in zip(batch.column(key).to_pylist(), utf8(batch, "text"), strict=True):
                own = list({_hash(x) for line in text.split(b"\n") if _long_enough(x := line_key(line), min_chars)})
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), type=pa.string()), pa.array(own, type=pa.binary())], names=[key, "hash"])

    found = texts.mapInArrow(hashes, f"`{key}` string, hash binary").distinct().join(frequent, "hash", "left_semi")
    lists = found.groupBy(key).agg(F.collect_set("hash").alias(own))  # at most the lines of one text
    marked = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256)).join(lists, key, "left").drop(key)
    return marked.mapInArrow(run, with_fields(docs, ddl))


def _frequent(docs: DataFrame, n_batches: int, min_docs: int, min_chars: int) -> DataFrame:
    spark = docs.sparkSession
    with freed(spark):
        store = LineRuns(spark, scratch(spark, "line-runs"))
        batch = F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), F.lit(n_batches)).cast("int")
        ingest(docs.select(batch.alias("batch"), "text"), "batch", store, min_chars)
        frequent = written(store.frequent(min_docs).select("hash"), "frequent-lines", outlives=True)
        store.forget()
        return frequent


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, n_batches: int = BATCHES, send_at_most: int = SEND_AT_MOST, prefix: str = "", counted: DataFrame | None = None) -> DataFrame:
    """Take in ``docs`` batch by batch, then drop the frequent lines; adds the columns of ``apply``.

    ``counted``: rows to count the lines of, if not those of ``docs``.
    """
    frequent = _frequent(docs if counted is None else counted, n_batches, min_docs, min_chars)
    return apply(docs, frequent, min_chars, send_at_most, prefix)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: lines, dropped lines, and the hash of what stays."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))

