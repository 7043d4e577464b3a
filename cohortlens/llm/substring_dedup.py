"""Exact removal of repeated word windows by level-wise doubling.

A window of ``window`` words is repeated when its words also start elsewhere.
Then so is every shorter word sequence in it, in particular its least one (by
hash) of a given length.  Lengths grow level by level, each twice the one
before, up to the window itself (9, 18, 35).  At a level each document block
sends the least sequences of the windows that are still candidates; those
that occur again somewhere are sent back as one bit each; windows whose least
sequence is alone are dropped, the others are looked at with twice the
length.  It ends at the window's length or when no candidate is left.

Equal documents are told apart by a hash of all their words, so a sequence
that only copies of one document hold does not keep its windows in the race;
such copies are covered whole.  A block sends a sequence once however often
it holds it, so a passage that a third of all rows share costs one entry a
block.  Sequences of the last level are told by 96 bits.

Words are runs without ASCII white space, unchanged.  Rows: null, empty and
short texts have no window and keep all words; repeated rows repeat each
other; a null id is kept.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from cohortlens.llm import blocks
from cohortlens.llm.common import arrow_table, mix64, written

WINDOW = 35
#: The first level has at least so many words.
FIRST = 9
ENTRY = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<u8"), ("again", "u1")])
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
DOCUMENTS = -1  # the level of whole documents


def lengths(window: int, first: int = FIRST) -> list[int]:
    """Lengths of the levels: the window, halved (rounded up) while at least ``first`` words stay."""
    out = [window]
    while -(-out[0] // 2) >= first:
        out.insert(0, -(-out[0] // 2))
    return out


def sequence_hashes(values: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hash of the ``length`` values from each place on, put together from powers of two."""
    n = len(values) - length + 1
    out, done, part, size, power = None, 0, values, 1, factor
    with np.errstate(over="ignore"):
        while size <= length:
            if length & size:
                out = part[:n].copy() if out is None else out * power + part[done : done + n]
                done += size
            part = part[:-size] * power + part[size:] if 2 * size <= length else part
            size, power = 2 * size, power * power
    return out


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over the ``width`` values from each place on."""
    size = 1
    while 2 * size <= width:
        a = best(a[:-size], a[size:])
        size *= 2
    return best(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


class Race:
    """The candidates of one block, taken through the levels."""

    def __init__(self, block: blocks.Block, window: int):
        from xxhash import xxh3_64_intdigest

        self.window, self.sizes, starts = window, block.sizes, block.starts
        word = np.fromiter(map(xxh3_64_intdigest, block.words), dtype=np.uint64, count=len(block.words))
        self.values = word[block.codes] if len(word) else np.zeros(0, dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(starts)), self.sizes)
        names = [int.from_bytes(hashlib.blake2b(self.values[s : s + n].tobytes(), digest_size=12).digest(), "little") for s, n in zip(starts.tolist(), self.sizes.tolist(), strict=True)]
        self.docs = np.array([x & 0xFFFFFFFFFFFFFFFF for x in names], dtype=np.uint64)
        self.doc_checks = np.array([x >> 64 for x in names], dtype=np.uint32)
        long = np.flatnonzero(self.sizes >= window)
        first = np.unique(self.docs[long], return_index=True)[1]
        self.owners = long[np.sort(first)]  # the first of equal documents stands for them
        n = max(0, len(self.values) - window + 1)
        self.alive = np.zeros(n, dtype=bool)
        for d in self.owners.tolist():
            self.alive[starts[d] : starts[d] + self.sizes[d] - window + 1] = True

    def whole(self) -> np.ndarray:
        """Entries of the documents that have a window."""
        long = np.flatnonzero(self.sizes >= self.window)
        own, first, count = np.unique(self.docs[long], return_index=True, return_counts=True)
        out = np.zeros(len(own), dtype=ENTRY)
        out["hash"], out["check"], out["again"] = own, self.doc_checks[long[first]], count > 1
        out["doc"] = np.arange(len(own))
        return out

    def entries(self, length: int) -> np.ndarray:
        """Sorted distinct least sequences of the candidate windows; ``at`` keeps each window's entry."""
        self.at = np.full(len(self.alive), -1)
        if not self.alive.any():
            return np.zeros(0, dtype=ENTRY)
        hashes = mix64(sequence_hashes(self.values, length, FACTORS[0]))
        width = self.window - length + 1
        least = np.where(self.alive, _sliding(hashes, width, np.minimum), np.uint64(0))
        # a place counts when it is the least of a candidate window around it
        padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)])
        places = np.flatnonzero((hashes == _sliding(padded, width, np.maximum)) & (hashes > 0))
        check = np.zeros(len(places), dtype=np.uint32)
        if length == self.window:
            check = (mix64(sequence_hashes(self.values, length, FACTORS[1])[places]) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((check, hashes[places]))
        places, check = places[order], check[order]
        h = hashes[places]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(new)
        out = np.zeros(len(first), dtype=ENTRY)
        out["hash"], out["check"], out["doc"] = h[first], check[first], self.docs[self.doc[places[first]]]
        out["again"] = np.diff(np.append(first, len(h))) > 1
        live = np.flatnonzero(self.alive)
        if length == self.window:
            entry_of = np.empty(len(h), dtype=np.int64)
            entry_of[:] = np.cumsum(new) - 1
            self.at[places] = entry_of
        else:
            self.at[live] = np.searchsorted(out["hash"], least[live])
        return out

    def keep(self, again: np.ndarray) -> None:
        """Drop the windows whose entry does not occur again."""
        live = np.flatnonzero(self.alive)
        self.alive[live] = again[self.at[live]]

    def covered(self, copies: np.ndarray) -> np.ndarray:
        """Words to remove; ``copies`` are the hashes of documents that occur more than once."""
        edge = np.zeros(len(self.values) + 1, dtype=np.int64)
        live = np.flatnonzero(self.alive)
        np.add.at(edge, live, 1)
        np.add.at(edge, live + self.window, -1)
        out = np.cumsum(edge[:-1]) > 0
        whole = np.isin(self.docs, copies) & (self.sizes >= self.window)
        return out | whole[self.doc] if len(out) else out


def _replayed(block: blocks.Block, window: int, done: list[int], bits: dict[int, np.ndarray]) -> Race:
    """The race of a block after the levels whose bits are known."""
    race = Race(block, window)
    for level in done:
        entries = race.entries(level)
        race.keep(bits[level][: len(entries)])
    return race


def _bits(table) -> dict[int, np.ndarray]:
    """Bits sent back to a block, by level, in the order of its entries."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "part", "n", "bits")), strict=True), key=lambda r: r[:2])
    out: dict[int, list[np.ndarray]] = {}
    for level, _, n, raw in rows:
        out.setdefault(level, []).append(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool))
    return {level: np.concatenate(x) for level, x in out.items()}


def _parts(block: int, level: int, entries: np.ndarray, n_parts: int):
    """The entries cut by hash range: (part, level, block, data)."""
    edges = np.searchsorted(entries["hash"], np.array([(k << 64) // n_parts for k in range(1, n_parts)], dtype=np.uint64))
    for part, own in enumerate(np.split(entries, edges)):
        if len(own):
            yield part, level, block, own.tobytes()


SENT = "part int, level int, block bigint, data binary"
BACK = "block bigint, level int, part int, n int, bits binary"


def resolve(sent: DataFrame, name: str) -> DataFrame:
    """For each sent entry a bit: does its sequence occur again, in another document or at another place?"""

    def run(table):
        rows = list(zip(*(table.column(c).to_pylist() for c in ("level", "block", "data")), strict=True))
        part, out = table.column("part")[0].as_py(), []
        for level in {r[0] for r in rows}:
            own = [(b, np.frombuffer(d, dtype=ENTRY)) for at, b, d in rows if at == level]
            every = np.concatenate([e for _, e in own])
            order = np.lexsort((every["check"], every["hash"]))
            ranked = every[order]
            new = np.ones(len(ranked), dtype=bool)
            new[1:] = (ranked["hash"][1:] != ranked["hash"][:-1]) | (ranked["check"][1:] != ranked["check"][:-1])
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(ranked)))
            if level == DOCUMENTS:
                again = sizes > 1
            else:
                again = np.minimum.reduceat(ranked["doc"], first) != np.maximum.reduceat(ranked["doc"], first)
            again |= np.maximum.reduceat(ranked["again"], first) > 0
            flags = np.empty(len(ranked), dtype=bool)
            flags[order] = np.repeat(again, sizes)
            at = 0
            for block, e in own:
                out.append((block, level, part, len(e), np.packbits(flags[at : at + len(e)]).tobytes()))
                at += len(e)
        return arrow_table(out, BACK)

    return written(sent.groupBy("part").applyInArrow(run, BACK), name)


def _level(window: int, levels: list[int], n_parts: int):
    """The pass that sends the entries of the last of ``levels``, given the bits of those before."""
    *done, level = levels

    def run(key, left, right):
        rows = []
        if left.num_rows:
            race = _replayed(blocks.unpack(left), window, done, _with_default(_bits(right), done))
            rows = list(_parts(key[0].as_py(), level, race.entries(level), n_parts))
        return arrow_table(rows, SENT)

    return run


def dedup(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """Per document: words, removed words, and the kept words joined by one blank."""
    spark = docs.sparkSession
    levels = lengths(window, first)
    n_parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = blocks.encode(docs, F.lit(False), False, "substring_blocks")

    def begin(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                race, block = Race(blocks.unpack(row), window), row.column("block")[0].as_py()
                rows = [*_parts(block, DOCUMENTS, race.whole(), n_parts), *_parts(block, levels[0], race.entries(levels[0]), n_parts)]
                yield from arrow_table(rows, SENT).to_batches()

    back = resolve(table.mapInArrow(begin, SENT), "substring-bits")
    for k in range(1, len(levels)):
        if not _any_again(back, levels[k - 1]):
            break

        sent = table.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_level(window, levels[: k + 1], n_parts), SENT)
        back = back.unionByName(resolve(sent, "substring-bits"))

    id_type = table.schema["ids"].dataType.elementType
    schema = StructType([StructField("doc_id", id_type), *StructType.fromDDL("n_words bigint, n_removed bigint, kept_text string").fields])
    arrow = to_arrow_schema(schema)

    def finish(key, left, right):
        rows = []
        if left.num_rows:
            block, bits = blocks.unpack(left), _bits(right)
            race = _replayed(block, window, levels, _with_default(bits, levels))
            whole = race.whole()["hash"]
            gone = race.covered(whole[bits[DOCUMENTS][: len(whole)]] if DOCUMENTS in bits else whole[:0])
            for doc, s, n in zip(block.ids, block.starts.tolist(), block.sizes.tolist(), strict=True):
                codes, out = block.codes[s : s + n], gone[s : s + n]
                removed = int(out.sum())
                kept = b" ".join(map(block.words.__getitem__, (codes[~out] if removed else codes).tolist()))
                rows.append((doc, n, removed, kept.decode()))
        return arrow_table(rows, arrow)

    return table.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, schema)


def _any_again(back: DataFrame, level: int) -> bool:
    """Whether some entry of the level occurs again."""
    return bool(back.where((F.col("level") == level) & (F.regexp_replace(F.hex("bits"), "0", "") != "")).take(1))


def _with_default(bits: dict[int, np.ndarray], levels: list[int]) -> dict[int, np.ndarray]:
    """Levels that sent nothing for this block have no bits."""
    return {level: bits.get(level, np.zeros(0, dtype=bool)) for level in levels}


def digests(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words, and the hash of the kept words."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
