from collections import Counter

from odd import ROWS, SPACE, corpus, lower, rows_of, sha, table

from cohortlens.llm import line_dedup
from cohortlens.llm.common import scratch


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least=10):
    seen = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def result(df):
    from pyspark.sql import functions as F

    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=str)


def test_against_brute_force_by_both_ways(spark):
    rows = rows_of(corpus()) + list(ROWS)
    want = sorted(brute(rows), key=str)
    df = table(spark, rows).drop("kept_text")
    assert any(r[2] for r in want)
    assert result(line_dedup.dedup(df)) == want
    assert result(line_dedup.dedup(df, send_at_most=0)) == want
    assert sorted(map(tuple, line_dedup.digests(table(spark, rows)).collect()), key=str) == want


def test_runs_are_levelled_and_tell_new_keys(spark):
    from pyspark.sql import functions as F

    rows = rows_of(["a\nb", "b\nc", "c\nd", "a", "e\na", "f"])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("batch", F.col("doc_id").cast("int"))
    store = line_dedup.LineRuns(spark, scratch(spark, "runs"), fanout=2)
    assert line_dedup.ingest(df, "batch", store) == [2, 1, 1, 0, 1, 1]
    assert sorted(level for level, _ in store.runs) == [1, 2]
    rows = store.stored().collect()
    assert len(rows) == len({bytes(r["hash"]) for r in rows}) == 6  # a key lies in one run
    counts = sorted(r["docs"] for r in store.frequent(1).collect())
    assert counts == [1, 1, 1, 2, 2, 3]
    assert store.frequent(3).count() == 1
    # the stored side is read as it lies: the batch alone is shuffled
    plan = store.fresh(df.select(F.unhex(F.md5("text")).alias("hash"), F.lit(1).cast("long").alias("docs")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1
    store.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.name)]


def test_the_anti_join_decides_the_result(spark, monkeypatch):
    """A join that finds nothing new leaves the runs without keys; one that finds all new splits their counts."""
    rows = rows_of([f"line {i % 3}\nown {i}" for i in range(60)])
    df = table(spark, rows).drop("kept_text")
    want = sorted(brute(rows), key=str)
    assert result(line_dedup.dedup(df)) == want and {r[2] for r in want} == {1}
    monkeypatch.setattr(line_dedup.LineRuns, "fresh", lambda self, batch: batch.where("false"))
    assert {r[2] for r in result(line_dedup.dedup(df))} == {0}
    monkeypatch.setattr(line_dedup.LineRuns, "fresh", lambda self, batch: batch)
    assert result(line_dedup.dedup(df)) != want


def test_min_chars_and_empty_table(spark):
    rows = rows_of(["é\nlong line"] * 3)
    df = table(spark, rows).drop("kept_text")
    assert {r[2] for r in result(line_dedup.dedup(df, min_docs=2, min_chars=2))} == {1}
    assert line_dedup.digests(table(spark, [])).count() == 0
    assert SPACE.split("a b") == ["a", "b"]
