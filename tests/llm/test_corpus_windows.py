import random
from collections import Counter

import numpy as np
from odd import ROWS, corpus, rows_of, sha, table, words

from cohortlens.llm import substring_dedup


def brute(rows, window=35):
    seen = Counter(tuple(w[i : i + window]) for r in rows for w in [words(r[1])] for i in range(len(w) - window + 1))
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = rows_of(corpus(150)) + list(ROWS)
    want = brute(rows)
    assert any(0 < r[2] < r[1] for r in want)
    assert sorted(map(tuple, substring_dedup.digests(table(spark, rows)).collect()), key=str) == want


def test_many_blocks_and_short_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup.blocks, "BLOCK_WORDS", 50)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60))), "en", "s") for i in range(60)]
    for window, first in ((6, 2), (7, 7), (12, 3)):
        out = substring_dedup.dedup(table(spark, rows).repartition(5), window, first).collect()
        assert sorted(((r[0], r[1], r[2], sha(r[3])) for r in out), key=str) == brute(rows, window)


def test_levels_and_hashes():
    assert substring_dedup.lengths(35) == [9, 18, 35]
    assert substring_dedup.lengths(8) == [8]
    v = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for n in (1, 2, 5, 9, 18, 35):
        h = substring_dedup.sequence_hashes(v, n, substring_dedup.FACTORS[0])
        assert len(h) == 200 - n + 1
        same = {}
        for i, x in enumerate(h.tolist()):
            assert same.setdefault(x, tuple(v[i : i + n])) == tuple(v[i : i + n])
        assert len(set(h.tolist())) == len({tuple(v[i : i + n]) for i in range(200 - n + 1)})


def test_nothing_repeated_and_empty_table(spark):
    rows = rows_of([" ".join(f"{k}x{i}" for i in range(80)) for k in range(5)])
    assert {r["n_removed"] for r in substring_dedup.digests(table(spark, rows)).collect()} == {0}
    assert substring_dedup.digests(table(spark, [])).count() == 0
