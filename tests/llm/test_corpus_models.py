import math
import zlib
from collections import Counter

import numpy as np
from odd import ROWS, corpus, lower, rows_of, table, words

from cohortlens.llm import hpylm, langid, quality_crf

DATA = "/root/testdata/sf0.01"


def bucket(doc, m):
    return zlib.crc32(str("" if doc is None else doc).encode()) % m


def tokens(text):
    return [*words(lower(text)), ""]


def test_base_scores_and_counts(spark):
    rows = rows_of(corpus()) + [(r[0] and 1000 + r[0], *r[1:]) for r in ROWS]
    train = [t for r in rows if bucket(r[0], 7) != 2 for t in tokens(r[1])]
    c, n = Counter(train), len(train)
    want = {(str(r[0]), r[1]): (bucket(r[0], 7) == 2, len(tokens(r[1])), sum(c[t] > 0 for t in tokens(r[1])), sum(math.log10((c[t] + 1) / (n + len(c) + 1)) for t in tokens(r[1]))) for r in rows}
    out = hpylm.report(table(spark, rows)).collect()
    assert len(out) == len(rows) and {r["train_tokens"] for r in out} == {n}
    by_id = {str(r[0]): r for r in out}
    for (doc, _), (held, size, known, base) in want.items():
        r = by_id[doc]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (held, size, known)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0 and math.isclose(r["perplexity"], 10 ** (-r["score"] / size), rel_tol=1e-6)


def test_model_beats_the_unigram_on_held_out_texts(spark):
    out = hpylm.report(spark.read.parquet(f"{DATA}/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"] + 1000


def test_probabilities_sum_to_one_and_runs_agree(spark, monkeypatch):
    rows = rows_of(["a b a b c", "b c a a", "c c b a d"])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    from pyspark.sql import functions as F

    vocabulary = ["a", "b", "c", "d", "unseen"]
    probes = spark.createDataFrame([(100 + i, f"a {w}", "x", "x") for i, w in enumerate(vocabulary)] + [(200, "a", "x", "x")], df.schema)
    out = {r["doc_id"]: r["score"] for r in hpylm.score(df.union(probes), F.col("doc_id") < 100).collect()}
    again = {r["doc_id"]: r["score"] for r in hpylm.score(df.union(probes).repartition(3), F.col("doc_id") < 100).collect()}
    assert all(math.isclose(out[k], again[k], rel_tol=1e-6) for k in out)


def test_every_previous_word_has_a_restaurant(spark):
    from pyspark.sql import functions as F

    n = 150  # more than any fixed number of frequent words would hold apart
    rows = rows_of([f"a{i} b{i}" for i in range(n)] * 4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    probes = spark.createDataFrame([(10_000 + i, f"a{i} b{i}", "x", "x") for i in range(n)] + [(20_000 + i, f"a{i} b{(i + 1) % n}", "x", "x") for i in range(n)], df.schema)
    out = {r["doc_id"]: r["score"] for r in hpylm.score(df.union(probes), F.col("doc_id") < 10_000).collect()}
    assert all(out[10_000 + i] > out[20_000 + i] + 1 for i in range(n))


def test_seating_follows_the_restaurant_process():
    rng = np.random.default_rng(0)
    n, d, theta = 20_000, 0.5, 1.0
    # one dish alone: the table count has mean theta/d * ((theta+d)_c / (theta)_c - 1)
    for c in (1, 2, 10, 200):
        got = hpylm.seat(rng, np.full(n, c), np.full(n, theta), np.full(n, d), d).mean()
        rising = math.exp(math.lgamma(theta + d + c) - math.lgamma(theta + d) - math.lgamma(theta + c) + math.lgamma(theta))
        assert abs(got - theta / d * (rising - 1)) < 0.03 * got


def test_no_training_rows_and_empty_table(spark):
    from pyspark.sql import functions as F

    out = hpylm.score(table(spark), F.lit(False)).collect()
    assert len(out) == len(ROWS) and {r["n_known"] for r in out} == {0} and {r["base_score"] for r in out} == {0.0}
    assert hpylm.report(table(spark, [])).count() == 0


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_mixed_documents_get_both_languages(spark):
    """Mixtures of the first documents, by id, that hold one language each; tokens without a letter have none."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    rows = docs.where("length(text) between 1500 and 4000").orderBy("doc_id").select("lang", "text").collect()
    names, scores = langid.classify([r["text"].encode() for r in rows], model)
    whole = {}
    for r, name, score in zip(rows, names, scores, strict=True):
        if name == r["lang"] and score > 0.97:
            whole.setdefault(name, []).append([w for w in r["text"].split() if any(map(str.isalpha, w))])
    missed = []
    for a, b in (("en", "de"), ("en", "fr"), ("de", "es")):
        for x, y in zip(whole[a][:4], whole[b][:4], strict=True):
            for share in (0.25, 0.75):
                k = min(len(x), len(y))
                mixed = " ".join(x[: int(k * share)] + y[: int(k * (1 - share))]).encode()
                names, score = langid.classify([mixed], model)
                assert names == [a if share > 0.5 else b] and abs(score[0] - 0.75) < 0.12
                missed.append(abs(score[0] - 0.75))
    assert np.mean(missed) < 0.04


def test_language_of_awkward_rows(spark):
    out = langid.predictions(table(spark)).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == len(ROWS)
    assert all(got[k] == ("und", 0.0) for k in (2, 3, 4, 8)) and got[1][0] in ("en", "fr")
    assert {r["lang_pred"] for r in langid.annotate(table(spark), langid.LanguageModel([], np.zeros((langid.BUCKETS, 0), dtype=np.float32))).collect()} == {"und"}
    assert langid.predictions(table(spark, [])).count() == 0


def brute_quality(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_quality_counts(spark):
    rows = rows_of([t + ("\n" + t) * (i % 3 == 0) + " # <b>" for i, t in enumerate(corpus(60))]) + list(ROWS)
    out = quality_crf.judge(table(spark, rows), quality_crf.train([])).collect()
    got = sorted(((r[0], *r[1:7]) for r in out), key=str)
    assert got == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=str)
    assert all(not (r["base_failed"] and r["kept"]) for r in out)


def test_viterbi_is_the_best_sequence():
    from itertools import product

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        scores, step = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        total = lambda y: sum(scores[i, k] for i, k in enumerate(y)) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert math.isclose(total(quality_crf.decode(scores, step)), max(map(total, product((0, 1), repeat=n))))


def test_field_tells_labelled_documents_apart(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.fit(docs, labels, per_class=40)
    out = quality_crf.judge(docs, field).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in out if r["quality"] == 1]
    bad = [r["kept"] for r in out if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    field = quality_crf.fit(table(spark), labels)
    assert quality_crf.judge(table(spark), field).where("NOT base_failed AND NOT kept").count() == 0
    assert quality_crf.judge(table(spark, []), field).count() == 0
