"""A trie of conversation prefixes, from range minima over sorted LCPs.

A conversation is a sequence of turns (role, text); a node is a distinct
sequence of first turns, the root the empty one.  A turn is named by the first
16 bytes of the SHA-256 of its role's byte count, role and text, so a
conversation is the string of its turns' names, and the order of such strings
puts every node's members side by side.

Method: conversations are sorted by (names, id) over range partitions, which
are read in *blocks* of at most ``BLOCK_TURNS`` turns.  In a block:

* LCP[i] is the number of turns conversation i shares with its predecessor;
* each prefix is a candidate where it first stands: (i, d) for LCP[i] < d <=
  length; a sparse table over the LCPs answers range minima, and each
  candidate finds the right end of its members, and the left end of its
  parent's, by a binary search of its own (doubling steps), without a stack;
* sums over members come from running sums: a subtree's distinct turns are
  those past the LCP of each member, its leaves the members whose successor
  does not hold them whole; smallest ids from a second sparse table.

A node that touches an end of its block may go on in the next one.  Such
*border* nodes (the prefixes of a block's first and last conversation) carry
their digest and are added up over blocks; where two blocks meet, the prefixes
that both sides counted as new are taken off again.  Only border nodes, their
children's names of them and long lists of ids are shuffled a second time: a
sequence, first turn or node that most conversations share is spread over all
blocks.

A single conversation is one record: 20 bytes a turn.

Defined results: null role or text is empty; turns go by number, null first,
ties by name; conversations without an id are left out; an empty table has no
node.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import arrow_schema, written

#: Turns (and conversations) of a block; a longer conversation is a block of its own.
BLOCK_TURNS = 1 << 18
NAME = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

#: kind 0: whole node; 1: part of a border node; 2: first and last conversation of a partition; 3: ids of a border node; 4: correction of a border node.
ROWS = (
    "kind int, block bigint, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, first_key binary, first_sizes binary, last_key binary, last_sizes binary"
)


# ------------------------------------------------------------------ conversations
def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the turns' names joined, and code points by turn.

    Conversation c takes its first h = crc32(c) mod 6 turns from conversation
    c - c mod 100 and the rest from its own turns after the first h.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME)
    turn = F.struct(F.col("turn"), name.alias("name"), F.length(text).alias("size"))
    own = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = written(own, "trie-conversations")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("home"), F.slice("turns", 1, 5).alias("head"))
    both = own.withColumns({"home": F.col("conv_id") - F.col("conv_id") % 100, "h": (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")}).join(heads, "home", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    turns = F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns")))
    both = both.select("conv_id", turns.alias("turns"))
    return both.select("conv_id", F.unhex(F.concat_ws("", F.transform("turns", lambda t: t["name"]))).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


# ------------------------------------------------------------------ one block
class Minima:
    """A sparse table: row k holds the minima of 2^k values from each place on."""

    def __init__(self, values: np.ndarray):
        rows, width = [values], 1
        while 2 * width <= len(values):
            longer = values.copy()
            longer[: len(values) - width] = np.minimum(rows[-1][: len(values) - width], rows[-1][width:])
            rows.append(longer)
            width *= 2
        self.rows, self.n = np.stack(rows), len(values)

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima from ``first`` to ``last``, both included."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self.rows[k, first], self.rows[k, last - (1 << k) + 1])

    def right(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place that can be reached from ``place`` over values of ``depth`` and more."""
        at = place.copy()
        for k in reversed(range(len(self.rows))):
            ok = (at + (1 << k) < self.n) & (self.rows[k, np.minimum(at + 1, self.n - 1)] >= depth)
            at += np.where(ok, 1 << k, 0)
        return at

    def left(self, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place from which ``place`` is reached over values of ``depth`` and more."""
        at = place.copy()
        for k in reversed(range(len(self.rows))):
            ok = (at >= 1 << k) & (self.rows[k, np.maximum(at - (1 << k) + 1, 0)] >= depth)
            at -= np.where(ok, 1 << k, 0)
        return at


def _shared(names: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Turns that each conversation shares with its predecessor; -1 for the first."""
    out = np.full(len(lengths), -1, dtype=np.int64)
    most = np.minimum(lengths[:-1], lengths[1:])
    out[1:] = most
    pairs = np.flatnonzero(most > 0)
    if len(pairs):
        m = most[pairs]
        begin = np.cumsum(m) - m
        j = np.arange(m.sum()) - np.repeat(begin, m)
        differ = (names[np.repeat(starts[pairs], m) + j] != names[np.repeat(starts[pairs + 1], m) + j]).any(axis=1)
        out[pairs + 1] = np.minimum(m, np.minimum.reduceat(np.where(differ, j, np.iinfo(np.int64).max), begin))
    return out


def prefix_digests(key: bytes) -> list[bytes]:
    """A digest for the first 0, 1, 2, ... turns of a conversation."""
    h = hashlib.sha256()
    out = [h.digest()]
    for at in range(0, len(key), NAME):
        h.update(key[at : at + NAME])
        out.append(h.copy().digest())
    return out


def _rows(columns: dict, n: int):
    """An Arrow table of ``ROWS`` with the given columns, the others null."""
    import pyarrow as pa

    schema = arrow_schema(ROWS)
    return pa.Table.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def nodes(block: int, ids: np.ndarray, keys: list[bytes], sizes: list[np.ndarray]):
    """Arrow tables of the nodes of a block, whose conversations are sorted by (key, id)."""
    lengths = np.array([len(x) for x in sizes], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    names = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    run = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    points = lambda i, d: run[starts[i] + d] - run[starts[i]]  # code points of the first d turns
    n, every = len(ids), np.arange(len(ids))
    lcp = _shared(names, starts, lengths)
    table = Minima(lcp)

    # candidates: every prefix, where it first stands
    count = lengths - lcp
    base = np.cumsum(count) - count
    i = np.repeat(every, count)
    d = np.arange(count.sum()) - np.repeat(base, count) + lcp[i] + 1
    last = table.right(i, d)
    opens = np.flatnonzero((count > 0) & (lcp >= 0))  # their first candidate branches off an earlier conversation
    home = table.left(opens, lcp[opens])
    parent = np.arange(len(i)) - 1
    parent[base[opens]] = base[home] + lcp[opens] - lcp[home] - 1

    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    total = points(every, lengths)
    leaves, whole, fresh = sums(np.append(lcp[1:], -1) < lengths), sums(total), sums(total - points(every, np.maximum(lcp, 0)))
    n_convs = last - i + 1
    before = points(i, np.maximum(d - 1, 0))
    saved = (whole[last + 1] - whole[i] - n_convs * before) - (fresh[last + 1] - fresh[i + 1] + total[i] - before)
    smallest = Minima(ids).least(i, last)
    columns = {"conv_id": smallest, "depth": d, "n_convs": n_convs, "n_children": np.bincount(parent[1:], minlength=len(i)), "n_leaves": leaves[last + 1] - leaves[i], "saved_tokens": saved}

    # members that end at a node: a run of equal conversations, in the order of their ids
    begins = np.flatnonzero(count > 0)
    runs = np.append(begins[1:], n)
    ended = base[begins] + count[begins] - 1
    border = (i == 0) | (last == n - 1)
    left, right = prefix_digests(keys[0]), prefix_digests(keys[-1])
    digest = lambda q: left[d[q]] if i[q] == 0 else right[d[q]]
    texts = {int(q): ",".join(map(str, ids[b:e].tolist())) for q, b, e in zip(ended, begins, runs, strict=True)}

    inner = np.flatnonzero(~border)
    up = border[parent[inner]]
    shas = [hashlib.sha256(texts[q].encode()).hexdigest() if q in texts else EMPTY_SHA for q in inner.tolist()]
    parents = [digest(p) if b else None for p, b in zip(parent[inner].tolist(), up.tolist(), strict=True)]
    yield _rows({"kind": np.zeros(len(inner)), "block": np.full(len(inner), block), "parent": parents, "parent_conv_id": np.where(up, 0, smallest[parent[inner]]), "ends": shas, **{k: v[inner] for k, v in columns.items()}}, len(inner))

    outer = np.flatnonzero(border)
    parents = [digest(parent[q]) if d[q] else None for q in outer]
    yield _rows({"kind": np.ones(len(outer)), "block": np.full(len(outer), block), "node": [digest(q) for q in outer], "parent": parents, **{k: v[outer] for k, v in columns.items()}}, len(outer))
    listed = [q for q in outer.tolist() if q in texts]
    yield _rows({"kind": np.full(len(listed), 3), "block": np.full(len(listed), block), "node": [digest(q) for q in listed], "ends": [texts[q] for q in listed]}, len(listed))


def corrections(block: int, last_key: bytes, last_sizes: np.ndarray, first_key: bytes):
    """What two meeting blocks both counted as new: the prefixes that their neighbours share."""
    here, there = (np.frombuffer(k, dtype="<u8").reshape(-1, 2) for k in (last_key, first_key))
    m = min(len(here), len(there))
    differ = np.flatnonzero((here[:m] != there[:m]).any(axis=1))
    c = int(differ[0]) if len(differ) else m
    d = np.arange(c + 1)
    run = np.concatenate([[0], np.cumsum(last_sizes[:c])]).astype(np.int64)
    digests = prefix_digests(last_key[: c * NAME])
    zero = np.zeros(c + 1, dtype=np.int64)
    columns = {"kind": zero + 4, "block": zero + block, "node": digests, "parent": [None, *digests[:-1]], "depth": d, "n_convs": zero, "n_children": -(d < c).astype(np.int64), "n_leaves": zero - int(c == len(here)), "saved_tokens": run[c] - run[np.maximum(d - 1, 0)]}
    return _rows(columns, c + 1)


# ------------------------------------------------------------------ over all blocks
def _in_blocks(batches, block_turns: int):
    """Rows of ``ROWS`` from one range partition, sorted by (key, id)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first, last, made, ids, keys, sizes, held = None, None, 0, [], [], [], 0

    def block():
        number = (part << 32) + made
        if last:
            yield corrections(number, *last, keys[0])
        yield from nodes(number, np.array(ids, dtype=np.int64), keys, sizes)

    for batch in batches:
        for doc, key, size in zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist(), batch.column("sizes"), strict=True):
            size = size.values.to_numpy(zero_copy_only=False).astype(np.int64)
            first = first or (key, size)
            if keys and held + len(size) + 1 > block_turns:
                for t in block():
                    yield from t.to_batches()
                last, made, ids, keys, sizes, held = (keys[-1], sizes[-1]), made + 1, [], [], [], 0
            ids.append(doc)
            keys.append(key)
            sizes.append(size)
            held += len(size) + 1
    if keys:
        for t in block():
            yield from t.to_batches()
        edge = {"kind": [2], "block": [part], "first_key": [first[0]], "first_sizes": [first[1].tobytes()], "last_key": [keys[-1]], "last_sizes": [sizes[-1].tobytes()]}
        yield from _rows(edge, 1).to_batches()


def _at_edges(batches):
    """Corrections where one partition ends and the next begins."""
    for batch in batches:
        for r in batch.to_pylist():
            yield from corrections(r["block"], r["before_key"], np.frombuffer(r["before_sizes"], dtype=np.int64), r["first_key"]).to_batches()


def _lists(batches):
    """The digest of each node's ids, whose pieces come in order."""
    import pyarrow as pa

    node, h = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["node", "ends"])
    for batch in batches:
        for own, piece in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if own != node:
                if h:
                    yield done()
                node, h = own, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.encode())
    if h:
        yield done()


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes over ``sequences`` (conv_id, key, sizes): one row a node."""
    block_turns = BLOCK_TURNS
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(sequences, "trie-sequences").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = written(placed.select("conv_id", "key", "sizes").mapInArrow(lambda batches: _in_blocks(batches, block_turns), ROWS), "trie-rows")

    by_part = Window.orderBy("block")  # one row a partition
    edges = rows.where("kind = 2").select("block", "first_key", F.lag("last_key").over(by_part).alias("before_key"), F.lag("last_sizes").over(by_part).alias("before_sizes"))
    between = edges.where("before_key IS NOT NULL").mapInArrow(_at_edges, ROWS)

    partial = rows.where("kind = 1")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = rows.where("kind IN (1, 4)").unionByName(between).groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    lists = rows.where("kind = 3").select("node", "block", "ends").repartition("node").sortWithinPartitions("node", "block").mapInArrow(_lists, "node binary, ends string")
    border = written(border.join(lists, "node", "left"), "trie-border")

    named = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    by_block = partial.select("block", "node").join(border.select("node", "conv_id"), "node").select("block", F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    inner = rows.where("kind = 0")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256")]
    deep = inner.where("parent IS NULL").select(*out)
    below = inner.where("parent IS NOT NULL").drop("parent_conv_id").join(by_block, ["block", "parent"]).withColumnRenamed("above", "parent_conv_id").select(*out)
    return deep.unionByName(below).unionByName(border.join(named, "parent", "left").select(*out))


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return trie(rebuilt(conversations))
