"""Benchmark decontamination by spaced seeds.

Fixed masks look at some token positions of a window and ignore the others,
so a substituted token under an ignored position does not hide a shared
passage.  Masked windows of the benchmark items and of the documents are
hashed alike; equal hashes are hits.  A hit fixes an alignment, and along it
the best run of matching tokens is worked out, with substitutions paying a
penalty.  The run confirms the overlap when it has enough matching tokens.

The benchmark is the query set: it goes out in blocks of bounded size, each
held against all documents, so neither side is shuffled and a benchmark of
any size stays within memory.

Tokens: lower-cased ASCII letters, ASCII punctuation dropped, split at white
space.  Rows: null and empty texts match nothing; items of fewer than
``MIN_TOKENS`` tokens are too short to be evidence and match nothing;
repeated documents are each reported; repeated items are reported under each
of their ids.  Only id and text of either table are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WordHashes, mix64, text_chunks, utf8, with_fields

#: Masks of the seeds (1: position is looked at); fixed values.
MASKS = ("1110110111", "1101111011", "1111011101")
MIN_TOKENS = 10
#: Matching tokens that confirm an overlap, and what a substitution takes off the run.
MIN_MATCH, PENALTY = 12, 2.0
#: Characters of benchmark text in a block.
BLOCK_CHARS = 16 << 20
FILTER_BITS = 20
#: Bytes of text that a task takes at a time, and words whose hashes it keeps.
CHUNK, KNOWN_WORDS = 1 << 20, 100_000
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(None, _DROP).split()


def seed_hashes(values: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the masked window that starts at each position."""
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(salt + 1), dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j, bit in enumerate(mask):
        if bit == "1":
            out *= factor
            out += values[j : j + n]
    return mix64(out)


@dataclass
class Seeds:
    """Hashed windows of a block of items, sorted by hash, and the items' token hashes."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    passes: np.ndarray
    ids: list
    values: list[np.ndarray]


def index(rows: list[tuple]) -> Seeds:
    """Seeds of benchmark rows (id, text)."""
    word = WordHashes(1 << 62)
    ids, values, parts = [], [], []
    for item_id, text in rows:
        own = tokens((text or "").encode())
        if len(own) < MIN_TOKENS:
            continue
        v = word.of(own)
        for salt, mask in enumerate(MASKS):
            h = seed_hashes(v, mask, salt)
            parts.append((h, np.full(len(h), len(ids)), np.arange(len(h))))
        ids.append(item_id)
        values.append(v)
    if not parts:
        return Seeds(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(1 << FILTER_BITS, dtype=bool), ids, values)
    h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    passes = np.zeros(1 << FILTER_BITS, dtype=bool)
    passes[h >> np.uint64(64 - FILTER_BITS)] = True
    return Seeds(h[order], item[order], place[order], passes, ids, values)


def best_run(equal: np.ndarray, penalty: float = PENALTY) -> tuple[int, int, int]:
    """Start, end and matches of the highest-scoring run of an alignment (match 1, substitution ``-penalty``)."""
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -penalty))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return start, end, int(equal[start:end].sum())


def overlaps(texts: list[bytes], seeds: Seeds, word: WordHashes, min_match: int = MIN_MATCH) -> list[tuple[int, int, int, int, int]]:
    """Confirmed overlaps: (text, item, first token in the text, tokens of the run, matching tokens), the best of each pair."""
    if not len(seeds.hashes):
        return []
    lists = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    values = word.of([w for own in lists for w in own])
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    for salt, mask in enumerate(MASKS):
        h = seed_hashes(values, mask, salt)
        at = np.flatnonzero(seeds.passes[h >> np.uint64(64 - FILTER_BITS)])
        lo = np.searchsorted(seeds.hashes, h[at], side="left")
        hi = np.searchsorted(seeds.hashes, h[at], side="right")
        real = hi > lo
        for p, a, b in zip(at[real].tolist(), lo[real].tolist(), hi[real].tolist(), strict=True):
            doc = int(np.searchsorted(bounds, p, side="right")) - 1
            for k in range(a, b):
                item, shift = int(seeds.item[k]), p - int(seeds.place[k])
                if (doc, item, shift) in tried:
                    continue
                tried.add((doc, item, shift))
                own = seeds.values[item]
                first, last = max(shift, int(bounds[doc])), min(shift + len(own), int(bounds[doc + 1]))
                if last - first < min(min_match, len(own)):
                    continue
                start, end, match = best_run(values[first:last] == own[first - shift : last - shift])
                if match >= min(min_match, len(own)) and match > found.get((doc, item), (0, 0, 0))[2]:
                    found[doc, item] = (first + start - int(bounds[doc]), end - start, match)
    return [(doc, item, *rest) for (doc, item), rest in sorted(found.items())]


def blocks(benchmark: DataFrame, item_id: str = "item_id", block_chars: int = BLOCK_CHARS):
    """The benchmark's seeds in blocks of about ``block_chars`` characters."""
    rows = benchmark.select(item_id, "text").where(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64(item_id, "text"), F.lit(n)) == k)
        yield index(sorted(part.collect(), key=lambda r: (r[0] is None, r[0], r[1])))


def hits(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(document, item) pairs with a confirmed overlap: where it starts, its tokens, and how many match."""
    import pyarrow as pa

    spark = docs.sparkSession
    picked = docs.select("doc_id", "text")
    kind = benchmark.schema["item_id"].dataType
    schema = with_fields(picked.select("doc_id"), f"item_id {kind.simpleString()}, start_token bigint, n_tokens bigint, n_matching bigint")
    out = None
    for seeds in blocks(benchmark, "item_id", block_chars):
        held = spark.sparkContext.broadcast(seeds)  # at most block_chars of text

        def run(batches, held=held):
            word = WordHashes(KNOWN_WORDS)
            for batch in text_chunks(batches, "text", CHUNK):
                got = overlaps(utf8(batch, "text"), held.value, word, min_match)
                if got:
                    doc, item, start, size, match = zip(*got, strict=True)
                    ids = [held.value.ids[i] for i in item]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(ids), *(pa.array(x, type=pa.int64()) for x in (start, size, match))], schema=_arrow(schema))

        part = picked.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without a confirmed overlap, with all their columns."""
    import pyarrow as pa

    spark = docs.sparkSession
    for seeds in blocks(benchmark, "item_id", block_chars):
        held = spark.sparkContext.broadcast(seeds)

        def run(batches, held=held):
            word = WordHashes(KNOWN_WORDS)
            for batch in text_chunks(batches, "text", CHUNK):
                bad = {k for k, *_ in overlaps(utf8(batch, "text"), held.value, word, min_match)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
