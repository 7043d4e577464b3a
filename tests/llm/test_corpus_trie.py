import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortlens.llm import conversation_trie
from cohortlens.llm.conversation_trie import Minima

SCHEMA = "conv_id long, turn long, role string, text string, key string, node string, block long, kind int, depth long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA)


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), name, (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, ms in members.items():
        below = [p for p in members if p[: len(node)] == node]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        ends = ",".join(map(str, sorted(c for c in ms if full[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), parent, len(ms), sum(len(p) == len(node) + 1 for p in below), sum(leaf(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_out(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def conversations(seed=1, n=160):
    """Shared first turns, copies, a hot conversation, absent heads, odd turns."""
    rnd = random.Random(seed)
    rows = []
    for c in [*range(n), *range(1205, 1260, 3), 5000]:
        k = rnd.randrange(1, 8)
        for t in range(k):
            text = rnd.choice(["hello", "good day É", "", "a longer turn of words"]) if t < 3 else f"turn {rnd.randrange(4)}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    for c in range(2001, 2080):  # one conversation many times, its head absent
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    rows += [(3001, t, "user", "long " + str(t)) for t in range(400)]
    rows += [(4001, None, "user", "no number"), (4001, 2, None, None), (4001, 2, None, None), (4001, 1, "user", None), (None, 1, "user", "no conversation")]
    rnd.shuffle(rows)
    return rows


def test_sparse_table_against_scans():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 100):
        lcp = rng.integers(0, 4, n)
        lcp[0] = -1
        table, at = Minima(lcp), np.arange(n)
        for d in range(5):
            depth = np.full(n, d)
            right, left = table.right(at, depth), table.left(at, depth)
            for i in range(n):
                r = i
                while r + 1 < n and lcp[r + 1] >= d:
                    r += 1
                first = i
                while first > 0 and lcp[first] >= d:
                    first -= 1
                assert (right[i], left[i]) == (r, first)
        lo = rng.integers(0, n, 50)
        hi = rng.integers(lo, n)
        assert (table.least(lo, hi) == [lcp[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]).all()


@pytest.mark.parametrize("block_turns", [1, 12, 1 << 18])
def test_against_brute_force(spark, monkeypatch, block_turns):
    monkeypatch.setattr(conversation_trie, "BLOCK_TURNS", block_turns)
    rows = conversations()
    assert rows_out(conversation_trie.report(frame(spark, rows))) == brute(rows)


def test_only_turnless_conversations(spark):
    """Heads absent and too few own turns: the root alone, which is a leaf."""
    cs = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 >= 2]
    rows = [(c, 0, "user", "one turn") for c in cs]
    assert rows_out(conversation_trie.report(frame(spark, rows))) == brute(rows)
    assert brute(rows)[0][5] == 1


def test_empty_table(spark):
    assert conversation_trie.report(frame(spark, [])).collect() == []
    assert conversation_trie.report(frame(spark, [(None, 1, "user", "x")])).collect() == []
