"""Near-duplicate documents by a chosen-path similarity join.

A document is the set of its word shingles.  Documents with equal sets are
one class, so copies cost one row.  Classes carry minwise values of their
set.  At the top of each independent tree a class enters a node for every
chosen value ("this minwise position has this value"); similar classes meet
in many nodes.

First, in every node the classes that look alike are compared with the
node's pivot (two orders of pivots, so a class meets two of them); confirmed
pairs are links and their components labels.  Large nodes that still hold
several labels are compared with a few more pivots, round after round, which
ties the members of a large group together without comparing them all.  A
node whose classes all carry one label needs nothing more, however large it
is.  What then remains is joined between differing labels: nodes of up to
``WHOLE`` classes exhaustively, larger ones by branching on further minwise
positions, chosen from the node's own path, until they are small enough or,
at the last depth, exhaustively.  Nodes of more than ``SMALL`` classes are
dealt to cells, each with the pairs of two parts of about ``SIDE`` classes.  A
pair is looked at in the first exhaustive top node it shares and in no other.
Comparisons use a sketch of the minwise values with a wide margin, and between
members of large nodes a second, finer one; every link is confirmed on the
full sets.

Eight top values and margins of four and a half standard deviations leave a
pair at the threshold unseen with a chance of about one in a hundred thousand.

Rows: null, empty and blank texts have an empty set and link with nothing;
a text of fewer words than a shingle is one shingle; repeated rows are in one
class.  A null id is never a component's name unless nothing else is in it.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WordHashes, freed, mix64, text_chunks, utf8, with_fields, written
from cohortlens.llm.graph import components
from cohortlens.session import shuffles_freed

SHINGLE, PERCENT = 4, 80
#: Minwise positions kept; positions opened at the top (trees x values each) and at each deeper node.
POSITIONS, TREES, VALUES, BRANCH = 128, 4, 2, 2
#: Nodes of more classes than SMALL get further pivots and fine sketches; nodes of up to WHOLE are joined
#: exhaustively; depth of the trees below the top.
SMALL, WHOLE, DEPTH = 64, 8192, 2
#: Classes in a part of a cell, about; pairs that a cell's task compares at a time, at most.
SIDE, AT_ONCE = 4096, 1 << 18
#: Minwise positions of a fine sketch.
FINE = 1024
#: Rounds of further pivots for large nodes, and pivots of a node in a round.
ROUNDS, PIVOTS = 1, 24
#: Confirmed against one pivot's text in a group; classes whose keys are sent to every task, at most.
GROUP, SEND_AT_MOST = 32, 1_000_000
#: Bytes of text that a task takes at a time, and words whose hashes it keeps.
CHUNK, KNOWN_WORDS = 1 << 20, 100_000
SKETCH = [f"s{i}" for i in range(POSITIONS // 16)]


def shingle_sets(texts: list[bytes], k: int, word: WordHashes) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the number of its words."""
    lists = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    v = word.of([w for own in lists for w in own])
    factor = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(v) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled = rolled * factor + v[j : j + len(rolled)]
    rolled = mix64(rolled)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            short = np.uint64(n)
            for x in v[at : at + n]:
                short = np.uint64((int(short) * int(factor) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix64(np.array([short])) | np.uint64(1))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out, sizes


def minwise(sets: list[np.ndarray], positions: int = POSITIONS, seed: int = 7) -> np.ndarray:
    """Minwise values (rows: sets, columns: positions) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    draw = np.random.default_rng(seed).integers(0, 1 << 63, size=(positions, 2), dtype=np.uint64)
    out = np.empty((len(sets), positions), dtype=np.uint32)
    for p, (a, b) in enumerate(draw):
        out[:, p] = np.minimum.reduceat(((flat * (a * np.uint64(2) + np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """Four bits of each minwise value, sixteen to a long."""
    nibble = (values & np.uint32(15)).astype(np.uint64).reshape(len(values), -1, 16)
    shift = (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, None, :]
    return np.bitwise_or.reduce(nibble << shift, axis=2).view(np.int64)


def margin(percent: int, positions: int = POSITIONS) -> int:
    """Differing sketch positions that a pair at the threshold exceeds by four and a half standard deviations."""
    differ = (1 - percent / 100) * 15 / 16
    return int(np.ceil(positions * differ + 4.5 * np.sqrt(positions * differ * (1 - differ))))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per row: id, text key, set size, class (hash of the set; null when empty), minwise values and sketch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = docs.select("doc_id", text_key().alias("text_key"), "text")
    schema = with_fields(picked.select("doc_id", "text_key"), "n_shingles bigint, class binary, minwise array<int>, " + ", ".join(f"{s} bigint" for s in SKETCH))

    def run(batches):
        word, arrow = WordHashes(KNOWN_WORDS), to_arrow_schema(schema)
        for batch in text_chunks(batches, "text", CHUNK):
            sets, _ = shingle_sets(utf8(batch, "text"), k, word)
            full = [i for i, s in enumerate(sets) if len(s)]
            name = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            low, sketch = [None] * len(sets), np.zeros((len(sets), len(SKETCH)), dtype=np.int64)
            if full:
                values = minwise([sets[i] for i in full])
                sketch[full] = sketches(values)
                for i, row in zip(full, values.view(np.int32), strict=True):
                    low[i] = row
            cols = [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(name, type=pa.binary()), pa.array(low, type=pa.list_(pa.int32())), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return picked.mapInArrow(run, schema)


def _nibbles(x: str) -> str:
    """SQL: how many of a long's sixteen nibbles are not zero."""
    x = f"({x} | shiftrightunsigned({x}, 1))"
    return f"bit_count(({x} | shiftrightunsigned({x}, 2)) & 1229782938247303441L)"


def _differ(a: str, b: str) -> str:
    """SQL: sketch positions in which two rows differ."""
    return " + ".join(_nibbles(f"({a}.{s} ^ {b}.{s})") for s in SKETCH)


def _alike(a: str, b: str, percent: int) -> str:
    """SQL: sizes allow the threshold and the sketches differ little enough."""
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {_differ(a, b)} <= {margin(percent)}"


ROW = ["class", "n", *SKETCH]


def top_nodes(classes: DataFrame, columns: list[str] = ROW) -> DataFrame:
    """A row for each class and top node, with ``columns``; ``at`` is the node's position, and ``at / VALUES`` its tree."""
    spots = [F.struct(F.xxhash64(F.lit(p // VALUES), F.lit(p), F.col("top")[p]).alias("node"), F.lit(p).alias("at")) for p in range(TREES * VALUES)]
    return classes.select(*columns, F.explode(F.array(*spots)).alias("spot")).select(*columns, "spot.node", "spot.at")


def stars(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a: pivot, b) of classes that share a top node and look alike."""
    rows = top_nodes(classes)
    rank = F.xxhash64("class", F.floor(F.col("at") / VALUES) % 2)  # trees take the two orders in turn
    pivots = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct(rank.alias("rank"), *ROW)).alias("pivot")).where("size > 1")
    pivots = written(pivots.select("node", "pivot.*").drop("rank"), "pivots")
    met = rows.alias("y").join(pivots.alias("p"), "node").where(f"p.class != y.class AND {_alike('p', 'y', percent)}")
    return met.select(F.col("p.class").alias("a"), F.col("y.class").alias("b")).distinct()


def more_stars(classes: DataFrame, turn: int, percent: int) -> DataFrame | None:
    """Pairs (a: pivot, b) with different labels in large nodes; None when no large node is mixed.

    A round's pivots are the same classes in all nodes that hold them, so a
    group that meets in many nodes is compared with few.  Spark limits the
    groups of a rank filter before it shuffles.
    """
    rows = top_nodes(classes, [*ROW, "label"]).drop("at")
    mixed = written(_mixed(rows).where(F.col("size") > SMALL).select("node"), "large-nodes")
    if not mixed.take(1):
        return None
    rows = written(rows.join(mixed, "node"), "large-rows")
    order = Window.partitionBy("node").orderBy("rank", "class")
    ranked = rows.withColumn("rank", F.xxhash64("class", F.lit(turn))).withColumn("place", F.row_number().over(order))
    pivots = written(ranked.where(F.col("place") <= PIVOTS).drop("rank", "place"), "more-pivots")
    met = rows.alias("y").join(pivots.alias("p"), "node").where(f"p.label != y.label AND {_alike('p', 'y', percent)}")
    return met.select(F.col("p.class").alias("a"), F.col("y.class").alias("b")).distinct()


def relabel(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (with ``label``) after the links (a, b) have joined labels."""
    with freed(classes.sparkSession):
        if not links.take(1):
            return classes
        named = classes.select("class", "label")
        ends = links.join(named.select(F.col("class").alias("a"), F.col("label").alias("la")), "a").join(named.select(F.col("class").alias("b"), F.col("label").alias("lb")), "b")
        roots = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        columns = [F.coalesce("root", "label").alias("label") if c == "label" else F.col(c) for c in classes.columns]
        return written(classes.join(roots, classes["label"] == roots["node"], "left").select(*columns), "labelled", outlives=True)


def _mixed(rows: DataFrame) -> DataFrame:
    """(node, size) of the nodes that hold several labels."""
    label = F.xxhash64("label")
    out = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return out.where("lo != hi").select("node", "size")


def fine_sketches(classes: DataFrame, every: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(class, fine) for the given classes, from their full sets."""

    def run(batches):
        import pyarrow as pa

        word = WordHashes(KNOWN_WORDS)
        for batch in text_chunks(batches, "text", CHUNK):
            sets, _ = shingle_sets(utf8(batch, "text"), k, word)
            fine = sketches(minwise(sets, FINE, seed=11))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(list(fine), type=pa.list_(pa.int64()))], names=["class", "fine"])

    return written(texts_of(classes, every, docs).mapInArrow(run, "class binary, fine array<bigint>"), "fine-sketches")


def bit_planes(packed: np.ndarray) -> np.ndarray:
    """Sketches of four-bit values, sixteen to a long, as four planes: (plane, sketch, 64 positions to a long)."""
    nibbles = packed.view(np.uint8)
    nibbles = np.stack([nibbles & 15, nibbles >> 4], axis=2).reshape(len(packed), -1)
    return np.stack([np.packbits(nibbles >> b & 1, axis=1).view(np.uint64) for b in range(4)])


def planes_differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions in which sketches given as planes differ; the middle axes are broadcast."""
    out = 0
    for w in range(x.shape[-1]):
        unequal = x[0, ..., w] ^ y[0, ..., w]
        for b in range(1, 4):
            unequal |= x[b, ..., w] ^ y[b, ..., w]
        out = out + np.bitwise_count(unequal).astype(np.int16)
    return out


def _matrix(column, dtype=np.int64) -> np.ndarray:
    """An Arrow list column, its lists all of one length, as rows; null values are 0."""
    flat = column.combine_chunks().flatten()
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def cell_pairs(table, percent: int):
    """Pairs (a, b) of one cell: classes of different parts, or of its only part, that differ in label and look alike."""
    import pyarrow as pa

    def out(first, second):
        return pa.table({"a": pa.array(first, type=pa.binary()), "b": pa.array(second, type=pa.binary())})

    if table.num_rows < 2:
        return out([], [])
    names = table.column("class").to_pylist()
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    n = table.column("n").to_numpy()
    coarse = bit_planes(np.ascontiguousarray(np.stack([table.column(s).to_numpy() for s in SKETCH], axis=1)))
    fine = bit_planes(_matrix(table.column("fine")))
    before = _matrix(table.column("before"))
    held = before != 0
    part = table.column("part").to_numpy()
    left = np.flatnonzero(part == part.min())
    right = np.flatnonzero(part != part.min())
    alone = not len(right)
    right = left if alone else right
    first, second = [], []
    step = max(1, AT_ONCE // len(right))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        near = planes_differ(coarse[:, rows, None, :], coarse[:, None, right, :]) <= margin(percent)
        near &= label[rows, None] != label[None, right]
        x, y = np.nonzero(near)
        x, y = rows[x], right[y]
        keep = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        if alone:
            keep &= x < y
        x, y = x[keep], y[keep]
        seen = np.zeros(len(x), dtype=bool)
        for k in range(before.shape[1]):
            seen |= (before[x, k] == before[y, k]) & held[x, k]
        x, y = x[~seen], y[~seen]
        for k in range(0, len(x), AT_ONCE // 32):
            u, v = x[k : k + AT_ONCE // 32], y[k : k + AT_ONCE // 32]
            alike = planes_differ(fine[:, u], fine[:, v]) <= margin(percent, FINE)
            for i, j in zip(u[alike].tolist(), v[alike].tolist(), strict=True):
                first.append(min(names[i], names[j]))
                second.append(max(names[i], names[j]))
    return out(first, second)


def large_node_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a node of ``rows`` (with ``size``, ``fine`` and ``before``), cell by cell.

    A node's classes are dealt to parts, and every two parts meet in a cell,
    so a task holds two parts however large the node is.
    """
    parts = F.ceil(F.col("size") / SIDE)
    own = rows.withColumn("part", F.pmod(F.xxhash64("class"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    cells = own.select("node", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "class", "label", "n", *SKETCH, "fine", "before")
    return cells.groupBy("node", "lo", "hi").applyInArrow(lambda table: cell_pairs(table, percent), "a binary, b binary")


def unresolved(labelled: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of classes with different labels that share a node and look alike, by the recursion below the top."""
    places = top_nodes(labelled, ["class", "label"])
    mixed = written(_mixed(places), "mixed-nodes")
    # names alone are dealt by node; sketches join the rows that are left
    rows = places.drop("label").join(mixed, "node").join(labelled.select(*ROW, "label"), "class")
    rows = written(rows, "mixed-rows")
    # the exhaustive node of each class at each position: a pair belongs to the first that it shares
    by_place = [F.max(F.when(F.col("at") == p, F.col("node"))) for p in range(TREES * VALUES)]
    lists = written(rows.where(F.col("size") <= WHOLE).groupBy("class").agg(F.array(*by_place).alias("all")), "node-lists")
    members = rows.where(F.col("size") > SMALL).select("class").distinct()
    # once for each class: repeated rows stand for theirs together
    fine = fine_sketches(members, classes, docs, k).groupBy("class").agg(F.first("fine").alias("fine"))
    every = F.coalesce("all", F.array(*[F.lit(None).cast("bigint")] * (TREES * VALUES)))
    before = F.transform(every, lambda node, p: F.when((p < F.col("at")) | (F.col("size") > WHOLE), node))
    rows = rows.join(lists, "class", "left").withColumn("before", before).drop("all", "at")
    rows, out = written(rows, "mixed-rows"), None
    for depth in range(DEPTH + 1):
        own = rows if depth == DEPTH else rows.where(F.col("size") <= WHOLE)
        small = own.where(F.col("size") <= SMALL)
        met = f"x.class < y.class AND x.label != y.label AND {_alike('x', 'y', percent)} AND NOT coalesce(arrays_overlap(x.before, y.before), false)"
        pairs = small.alias("x").join(small.alias("y"), "node").where(met).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
        pairs = pairs.union(large_node_pairs(own.where(F.col("size") > SMALL).join(fine, "class"), percent))
        pairs = written(pairs, "node-pairs")
        out = pairs if out is None else out.union(pairs)
        large = rows.where(F.col("size") > WHOLE)
        if depth == DEPTH or not large.take(1):
            break
        # positions come from the node's own path, so all its classes branch alike
        spots = F.transform(F.sequence(F.lit(1), F.lit(BRANCH)), lambda i: F.pmod(F.xxhash64(F.col("node"), i), F.lit(POSITIONS)).cast("int"))
        deeper = large.drop("size").join(classes.select("class", "minwise"), "class").withColumn("spot", F.explode(F.array_distinct(spots)))
        deeper = written(deeper.withColumn("node", F.xxhash64("node", "spot", F.expr("minwise[spot]"))).drop("spot", "minwise"), "deeper-nodes")
        rows = written(deeper.join(written(_mixed(deeper), "mixed-nodes"), "node"), "mixed-rows")
    return out.distinct()


def texts_of(some: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, text) of the given classes, each from the row that stands for it."""
    need = some.join(classes, "class").select("class", F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_key"))
    need = written(need, "asked-classes")
    if need.count() <= SEND_AT_MOST:
        need = F.broadcast(need)  # two keys and an id for each class
    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    return keyed.join(need, (keyed.text_key == need["_key"]) & keyed.doc_id.eqNullSafe(need["_id"])).select("class", "text")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    with freed(docs.sparkSession):
        pairs = written(pairs, "pairs")
        need = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
        texts = written(texts_of(need, classes, docs), "pair-texts")
        degree = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "pair-degrees")
        dealt = written(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part")), "pair-groups")
        asked = dealt.select("a", "part", F.col("b").alias("class")).union(dealt.select("a", "part", F.col("a").alias("class")).distinct())
        groups = asked.join(texts, "class")

        def run(key, table):
            import pyarrow as pa

            a = key[0].as_py()
            names = table.column("class").to_pylist()
            sets, _ = shingle_sets([(t or "").encode() for t in table.column("text").to_pylist()], k, WordHashes(KNOWN_WORDS))
            own = sets[names.index(a)]
            found = set()
            for name, other in zip(names, sets, strict=True):
                if name != a:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.add(name)
            return pa.table({"a": pa.array([a] * len(found), type=pa.binary()), "b": pa.array(sorted(found), type=pa.binary())})

        return written(groups.groupBy("a", "part").applyInArrow(run, "a binary, b binary"), "links", outlives=True)


def cluster(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, label: bool = False) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles and component_id (the smallest id reachable over links).

    ``label``: also the component's own name, which repeated and null ids leave distinct; null for an empty set.
    """
    also = ["label"] if label else []
    base = written(signatures(docs, k), "signatures")
    with freed(docs.sparkSession), shuffles_freed(docs.sparkSession):
        sets = base.where(F.col("class").isNotNull())
        classes = sets.groupBy("class").agg(
            F.min("doc_id").alias("least_id"), F.min(F.struct("text_key", "doc_id")).alias("row"), F.first("n_shingles").alias("n"), F.first("minwise").alias("minwise"), *(F.first(s).alias(s) for s in SKETCH)
        )
        classes = written(classes.withColumn("top", F.slice("minwise", 1, TREES * VALUES)), "classes")
        labelled = relabel(classes.drop("minwise", "row").withColumn("label", F.col("class")), confirm(stars(classes, percent), classes, docs, k, percent))
        for turn in range(ROUNDS):
            pairs = more_stars(labelled, turn + 2, percent)
            if pairs is None:
                break
            labelled = relabel(labelled, confirm(pairs, classes, docs, k, percent))
        labelled = relabel(labelled, confirm(unresolved(labelled, classes, docs, k, percent), classes, docs, k, percent))
        names = written(labelled.groupBy("label").agg(F.min("least_id").alias("component_id")), "component-names")
        named = written(labelled.select("class", "label").join(names, "label").select("class", "component_id", *also), "class-names", outlives=True)
    out = base.select("doc_id", "text_key", "n_shingles", "class").join(named, "class", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *also)


def report(docs: DataFrame) -> DataFrame:
    """Per document: set size, component, and whether it stands for the component."""
    rows = cluster(docs).drop("text_key")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component; one of repeated rows.

    A component is stood for by its least (doc_id, text_key), null ids last.
    Rows with an empty set all stay.
    """
    with freed(docs.sparkSession):
        rows = cluster(docs, k, percent, label=True)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))).alias("least")
        kept = rows.where("label IS NOT NULL").groupBy("label").agg(least).select("least._id", "least._key", F.lit(False).alias("_empty"))
        empty = rows.where("label IS NULL").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.lit(True).alias("_empty")).distinct()
        kept = written(kept.unionByName(empty), "kept-keys", outlives=True)
    marked = docs.withColumn("_text_key", text_key())
    same = marked.doc_id.eqNullSafe(kept["_id"]) & (marked["_text_key"] == kept["_key"])
    joined = marked.join(kept, same).drop("_id", "_key")
    once = joined.where("NOT _empty").dropDuplicates(["doc_id", "_text_key"])
    return joined.where("_empty").unionByName(once).select(*docs.columns)

