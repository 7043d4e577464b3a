import random
from pathlib import Path

import pytest
from odd import ROWS, rows_of, table

import corpus_pipeline
from cohortlens.llm import decontam
from cohortlens.llm.common import written

ITEMS = "item_id bigint, text string"


def passages(n=6, size=24, seed=8):
    rnd = random.Random(seed)
    return [" ".join(f"q{rnd.randrange(500)}" for _ in range(size)) for _ in range(n)]


def documents(items, seed=2):
    """(texts, ids that hold a passage, ids that do not)."""
    rnd = random.Random(seed)
    filler = lambda k: " ".join(f"f{rnd.randrange(3000)}" for _ in range(k))
    texts, dirty = [], set()
    for i in range(80):
        t = filler(rnd.randrange(5, 300))
        if i % 5 == 0:
            w = rnd.choice(items).split()
            for k in range(3, len(w), 9):  # a substitution every nine words
                w[k] = "other"
            if i % 10 == 0:
                w = [x.upper() + "," for x in w]
            t, _ = f"{t} {' '.join(w)} {filler(20)}", dirty.add(i)
        elif i % 5 == 1:
            t += " " + " ".join(rnd.choice(items).split()[:8])  # too little to count
        texts.append(t)
    return texts, dirty


def test_substituted_passages_are_found_and_clean_ones_left(spark):
    items = passages()
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "too short")], ITEMS)
    texts, dirty = documents(items)
    df = table(spark, rows_of(texts) + [(900 + i, *r[1:]) for i, r in enumerate(ROWS)])
    for size in (decontam.BLOCK_CHARS, 150):  # one block and several
        got = decontam.hits(df, bench, block_chars=size).collect()
        assert {r["doc_id"] for r in got} == dirty
        for r in got:
            assert r["n_matching"] >= decontam.MIN_MATCH and r["n_tokens"] >= r["n_matching"]
        kept = decontam.clean(df, bench, block_chars=size)
        assert kept.columns == df.columns
        assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in df.collect()} - dirty


def test_nothing_to_hold_against(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontam.hits(table(spark), none).count() == 0
    assert decontam.clean(table(spark), none).count() == len(ROWS)
    assert decontam.hits(table(spark, []), spark.createDataFrame([(1, passages()[0])], ITEMS)).count() == 0


def test_best_run():
    import numpy as np

    assert decontam.best_run(np.array([1, 1, 1, 0, 1, 1, 1, 1], dtype=bool)) == (0, 8, 7)
    assert decontam.best_run(np.array([1, 0, 0, 1, 1], dtype=bool)) == (3, 5, 2)
    assert decontam.best_run(np.zeros(4, dtype=bool))[2] == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 %%%", "en", "s", 7), (10**6 + 2, "", "en", "s", 0)], source.schema)
    source.union(odd).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect_and_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.schema["doc_id"].dataType == seen[0].schema["doc_id"].dataType
    start, lang, lines, near, clean, last = seen
    gone = {r["doc_id"] for r in start.collect()} - {r["doc_id"] for r in lang.collect()}
    assert gone == {10**6, 10**6 + 1, 10**6 + 2}
    assert lines.count() == lang.count() and all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    from test_corpus_near_dup import brute

    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    keep = {doc for doc, n, component, kept in brute(rows, 5) if kept or not n}
    assert {r["doc_id"] for r in near.collect()} == keep
    hit = {r["doc_id"] for r in decontam.hits(near, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == keep - hit
    import hashlib

    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    got = last.collect()
    assert len(got) == len(text) and all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in got)
    assert corpus_pipeline.run(spark, folder).count() == len(got)


def test_copy_groups_keep_one_whole_text(spark):
    rnd = random.Random(4)
    line = lambda k: " ".join(f"v{rnd.randrange(5000)}" for _ in range(k))
    exact, near = ("\n".join(line(12) for _ in range(10)) for _ in range(2))
    texts = [exact] * 12 + [f"{near}\n{line(3)}" for _ in range(12)] + ["two words"] * 12 + [f"{line(40)}\nall rights reserved" for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cut = written(corpus_pipeline.drop_lines(spark, docs, ""), "test-copy-groups")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t.removesuffix("\nall rights reserved") for i, t in enumerate(texts)}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_near_copies(spark, cut, "").collect()}
    assert sorted(i for i in kept if i < 24) == [0, 12]
    assert kept[0] == texts[0] and kept[12] == texts[12]


def test_library_does_not_import_the_corpus_folder():
    root = Path(corpus_pipeline.__file__).parent / "cohortlens"
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "cohortlens.llm" not in path.read_text()


def test_every_stage_bounds_the_arrow_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    class Asked(Exception):
        pass

    def stop(*args, **kwargs):
        raise Asked(spark.conf.get(key))

    for module, name in ((corpus_pipeline.langid, "fit"), (corpus_pipeline.near_dup, "representatives"), (corpus_pipeline.decontam, "clean"), (corpus_pipeline.bpe, "encode")):
        monkeypatch.setattr(module, name, stop)
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path: None)
    try:
        for given, held in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            for _, stage in corpus_pipeline.STAGES:
                spark.conf.set(key, given)
                with pytest.raises(Asked, match=f"^{held}$"):
                    stage(spark, spark.range(1), "")
    finally:
        spark.conf.set(key, before)


def test_tokenizing_runs_one_python_worker_a_core(spark, capsys):
    import hashlib

    texts = ["two words", "", "caf\u00e9 it's  12345\n", "two words"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.tokenize(spark, docs, "")
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts) and got[1]["ids"] == []
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for i, r in got.items())


def test_every_stage_bounds_the_parquet_batches(spark):
    from cohortlens.session import bound_arrow_batches

    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        for given, held in (("4096", "1000"), ("200", "200")):
            spark.conf.set(key, given)
            bound_arrow_batches(spark)
            assert spark.conf.get(key) == held
    finally:
        spark.conf.set(key, before)


def test_decontamination_holds_few_texts_and_words_at_a_time(spark, monkeypatch):
    import numpy as np

    seen = []

    def overlaps(texts, seeds, word, min_match):
        seen.append((sum(map(len, texts)), word._limit))
        return []

    class Docs:
        sparkSession = spark
        schema = None

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 18)] * 40)], names=["text"])
            assert sum(b.num_rows for b in run([batch])) == 40
            return self

    monkeypatch.setattr(decontam, "overlaps", overlaps)
    monkeypatch.setattr(decontam, "blocks", lambda *a: [np.zeros(0)])
    decontam.clean(Docs(), None)
    assert max(n for n, _ in seen) <= 1 << 20 and all(limit <= 100_000 for _, limit in seen)
