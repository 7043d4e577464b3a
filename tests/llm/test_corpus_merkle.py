import random
import zlib

import pytest
from odd import ROWS, corpus, sha, table

from cohortlens.llm import merkle


def digest(row, more=0):
    doc, text, lang, source = row
    n = None if text is None else len(text) + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(hashes):
    """The top of a run of nodes, and the siblings of each by level."""
    paths, places = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, p in enumerate(places):
            other = p ^ 1
            paths[k].append((hashes[other] if other < len(hashes) else None, other < p))
            places[k] = p // 2
        hashes = [sha("".join(hashes[i : i + 2])) for i in range(0, len(hashes), 2)]
    return hashes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    tops = {g: climb([digest(r) for r in groups[g]]) for g in langs}
    root, above = climb([tops[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above, strict=True):
        for r, path in zip(groups[g], tops[g][1], strict=True):
            tampered = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 0
            at = digest(r, 1 if tampered else 0)
            for other, left in path + up:
                at = sha(at if other is None else other + at if left else at + other)
            siblings = "".join(h or "" for h, _ in path + up)
            out.append((r[0], digest(r), tops[g][0], root, sha(siblings), at, at == root))
    return sorted(out, key=str)


def rows_out(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def rows():
    rnd = random.Random(2)
    out = [(i, t, rnd.choice(["en", "en", "en", "fr", "É", "z"]), "s") for i, t in enumerate(corpus(140))]
    out += [(1000 + r[0] if r[0] is not None else None, *r[1:]) for r in ROWS] + [(5000, "the only one of its language", "zz", None)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_against_brute_force(spark, monkeypatch, levels):
    """With few levels a block, trees reach over several tiers of blocks."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    data = rows()
    got = rows_out(merkle.report(table(spark, data).repartition(3)))
    assert got == brute(data)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_groups(spark, n):
    data = [(i, f"text {i}", "en", "s") for i in range(n)]
    assert rows_out(merkle.report(table(spark, data))) == brute(data)


def test_one_language_each(spark):
    """As many subroots as rows: the tree over groups is the large one."""
    data = [(i, "x", f"l{i:03d}", "s") for i in range(300)]
    assert rows_out(merkle.report(table(spark, data))) == brute(data)


def test_empty_table(spark):
    assert merkle.report(table(spark, [])).collect() == []
