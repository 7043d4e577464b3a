import random

import numpy as np
import pytest
from odd import ROWS, corpus, lower, rows_of, table, words

from cohortlens.llm import near_dup
from cohortlens.llm.graph import components


def shingles(text, k=4):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, percent=80):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rows = rows_of(corpus(160)) + [(1000 + i if r[0] is not None else None, *r[1:]) for i, r in enumerate(ROWS)]
    out = near_dup.report(table(spark, rows)).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("whole", [5, 8192])
def test_large_nodes_lose_nothing(spark, monkeypatch, whole):
    monkeypatch.setattr(near_dup, "SMALL", 3)
    monkeypatch.setattr(near_dup, "WHOLE", whole)
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(70):  # near copies at all distances around the threshold
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(60)] = f"n{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    out = near_dup.report(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=str) == brute(rows)


def test_cells_hold_every_pair_of_a_large_node_once(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SIDE", 6)
    monkeypatch.setattr(near_dup, "AT_ONCE", 64)
    rnd = np.random.default_rng(3)

    def values(positions):
        own = np.repeat(rnd.integers(0, 1 << 32, size=(1, positions), dtype=np.uint32), 40, axis=0)
        for i, row in enumerate(own):
            at = rnd.random(positions) < i % 8 / 20
            row[at] = rnd.integers(0, 1 << 32, size=at.sum(), dtype=np.uint32)
        return own

    low, high = values(near_dup.POSITIONS), values(near_dup.FINE)
    coarse, fine = near_dup.sketches(low), near_dup.sketches(high)
    rows = []
    for i in range(40):
        before = [None] * 6 + [int(i % 5) + 1 if i % 3 else None, None]
        rows.append((7, 40, bytes([i]) * 16, bytes([i % 4]) * 16, 100 + i, *coarse[i].tolist(), fine[i].tolist(), before))
    columns = ["node bigint", "size bigint", "class binary", "label binary", "n bigint", *(f"{s} bigint" for s in near_dup.SKETCH), "fine array<bigint>", "before array<bigint>"]
    df = spark.createDataFrame(rows, ", ".join(columns))

    def alike(i, j):
        a, b = rows[i], rows[j]
        if a[3] == b[3] or a[-1][6] is not None and a[-1][6] == b[-1][6] or 100 * min(a[4], b[4]) < 80 * max(a[4], b[4]):
            return False
        unequal = lambda v: int(((v[i] ^ v[j]) & 15 != 0).sum())
        return unequal(low) <= near_dup.margin(80) and unequal(high) <= near_dup.margin(80, near_dup.FINE)

    want = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if alike(i, j))
    assert 20 < len(want) < 600
    got = sorted((r["a"][0], r["b"][0]) for r in near_dup.large_node_pairs(df, 80).collect())
    assert got == want
    table = df.drop("node", "size").toArrow().append_column("part", [[0] * 40])
    assert sorted((a[0], b[0]) for a, b in zip(*(near_dup.cell_pairs(table, 80)[c].to_pylist() for c in "ab"), strict=True)) == want
    assert near_dup.large_node_pairs(df.where("class = X'00000000000000000000000000000000'"), 80).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_representatives_and_empty_table(spark):
    rows = rows_of(["a b c d e f", "a b c d e f", "x y z u v w", "", None]) + [(9, "p q r s t u", "en", "s")] * 2
    df = table(spark, rows)
    kept = near_dup.representatives(df, k=5)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 9]
    assert near_dup.report(table(spark, [])).count() == 0


def test_one_row_stands_for_a_group_with_repeated_or_null_ids(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    near = lambda a: [f"{words(a)} end{i}" for i in range(3)]
    rows = [(7, t) for t in near("p")] + [(None, t) for t in near("q")] + [(None, t) for t in near("r")] + [(7, words("s")), (7, words("s")), (None, ""), (None, "")]
    out = near_dup.representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:1]) for r in out) == [(0, ""), (0, ""), (0, "q"), (0, "r"), (7, "p"), (7, "s")]
