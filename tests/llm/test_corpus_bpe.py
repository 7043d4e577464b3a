import hashlib
import random

import pytest
from odd import ROWS, table

from cohortlens.llm import bpe
from cohortlens.llm.queries import rank_file

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers  # noqa: E402


@pytest.fixture(scope="module")
def peer():
    ranks = bpe.read_ranks(rank_file())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point_class(peer):
    ranks, encoding = peer
    texts = [f"a{c}1{c}a {c}" for c in map(chr, [*range(0, 0xD800, 3), *range(0xE000, 0x30000, 17)])]
    assert [i for i, _ in bpe.Codec(ranks).encode(texts)] == encoding.encode_ordinary_batch(texts)


def test_random_texts_and_contractions(peer):
    ranks, encoding = peer
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aab cst'rvel dm  \n\t 1٣Ⅷ!?'é漢  \xa0\x1ć") for _ in range(rnd.randrange(50))) for _ in range(4000)]
    texts += ["x" * 5000, " " * 3000, "'" * 99, "ab" * 700, ""]
    codec = bpe.Codec(ranks)
    got = list(codec.encode(texts))
    assert [i for i, _ in got] == encoding.encode_ordinary_batch(texts)
    assert all(codec.decode(i) == t.encode() for (i, _), t in zip(got, texts, strict=True))


def test_scan_is_the_same_for_any_cut(monkeypatch):
    import numpy as np

    symbol = np.random.default_rng(1).integers(0, 9, 5000).astype(np.uint8)
    whole = bpe.token_starts(symbol)
    monkeypatch.setattr(bpe, "COLUMN", 7)
    assert (bpe.token_starts(symbol) == whole).all()


def test_offsets_and_round_trip(spark, peer):
    df = table(spark).drop("ids")
    out = bpe.decode(bpe.encode(df, rank_file()), rank_file()).collect()
    assert len(out) == len(ROWS)
    ranks, _ = peer
    size = {i: len(b) for b, i in ranks.items()}
    for r in out:
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == raw
        at = 0
        for i, o in zip(r["ids"], r["offsets"], strict=True):
            assert o == at
            at += size[i]
        starts = r["piece_starts"]
        assert starts == sorted(set(starts)) and (not starts or starts[0] == 0)


def test_digests_of_awkward_rows(spark, peer):
    _, encoding = peer
    out = bpe.digests(table(spark), rank_file()).collect()
    want = []
    for doc, text, *_ in ROWS:
        ids = encoding.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe.digests(table(spark, []), rank_file()).count() == 0


def test_decoding_takes_a_bounded_number_of_tokens_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    import pyarrow.compute as pc

    from cohortlens.llm.common import row_chunks

    ids = [[1] * n if n is not None else None for n in (3, 0, None, 9, 2, 2, 4, 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, type=pa.list_(pa.int32()))], names=["ids"])
    cut = list(row_chunks([batch, batch.slice(0, 0)], lambda b: pc.list_value_length(b.column("ids")), 5))
    assert [x for c in cut for x in c.column("ids").to_pylist()] == ids
    assert all(c.num_rows == 1 or sum(len(x or []) for x in c.column("ids").to_pylist()) <= 5 for c in cut)

    asked = []
    monkeypatch.setattr(bpe, "row_chunks", lambda batches, size, most: asked.append(most) or iter(()))
    frame = spark.createDataFrame([([1],)], "ids array<int>")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: list(run([])) or self)
    bpe.decode(frame, rank_file())
    assert asked == [bpe.TOKENS]
