import random

import numpy as np
import pytest
from odd import ROWS, corpus, lower, rows_of, sha, table

from cohortlens.llm import exact_dedup


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is not None, x), reverse=True)
        out += [(doc, ids[0], len(ids), k == 0, sha(text)) for k, doc in enumerate(ids)]
    return sorted(out, key=str)


def rows_out(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def copies():
    """A hot text, copies that differ in case alone, odd rows and a repeated id."""
    rows = rows_of(corpus(150)) + [(1000 + i, "One text that many ROWS hold" if i % 2 else "one text that MANY rows hold", "en", "hot") for i in range(90)]
    rows += [(2000 + r[0] if r[0] is not None else None, *r[1:]) for r in ROWS] + [(None, None, None, None)]
    random.Random(3).shuffle(rows)
    return rows


@pytest.mark.parametrize("mean", [0, 1, 3, 1000, 1 << 40])
def test_golomb_round_trip(mean):
    rng = np.random.default_rng(mean % 97)
    for n in (1, 2, 63, 500):
        gaps = rng.geometric(1 / (mean + 1), n).astype(np.uint64) - np.uint64(1)
        code = exact_dedup.golomb(gaps)
        assert (exact_dedup.gaps_of(code, n) == gaps).all()
    if mean == 1000:  # about two bits beyond the entropy's log2(mean), not 64
        assert len(code) * 8 < 500 * 13


def test_against_brute_force(spark):
    rows = copies()
    assert rows_out(exact_dedup.groups(table(spark, rows).repartition(5))) == brute(rows)


@pytest.mark.parametrize("bits", [-3, 20])
def test_many_parts_hot_texts_and_chance_suspects(spark, monkeypatch, bits):
    """Small parts and windows; with few bits most fingerprints meet by chance, and bytes tell them apart."""
    for name, value in {"PART_KEYS": 9, "WINDOW_BYTES": 1500, "HOT_PARTS": 2, "SALTS": 3, "EXTRA_BITS": bits, "OWNER_KEYS": 40}.items():
        monkeypatch.setattr(exact_dedup, name, value)
    rows = copies()
    assert rows_out(exact_dedup.groups(table(spark, rows).repartition(4))) == brute(rows)


def test_the_answers_decide_what_is_compared(spark, monkeypatch):
    """With owners that never saw a fingerprint twice, copies in different parts go unseen."""
    rows = [(i, "the same text", "en", "s") for i in range(40)]
    docs = table(spark, rows).repartition(4)
    assert {r[2] for r in rows_out(exact_dedup.groups(docs))} == {40}
    real = exact_dedup._answers
    blind = lambda messages, hot: real(messages.withColumn("owner", messages["part"]), hot)
    monkeypatch.setattr(exact_dedup, "_answers", blind)
    assert sum(r[3] for r in rows_out(exact_dedup.groups(docs))) == 4  # one in each part


def test_empty_table(spark):
    out = exact_dedup.groups(table(spark, []))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.collect() == []
