"""Secret scan over an incremental blob ledger.

Every version of every document is content-addressed by the SHA-256 of its
text (its blob).  The ledger in the shared folder says which (blob, rule
version) pairs were scanned and what was found.  A scan takes only the pairs
the ledger lacks, adds them, and joins the findings of a blob back to every
path that holds it.  A rule with a new version is scanned again; the rest of
the ledger stays as it is.

Only DataFrame functions run here.  A rule's matches come from
``regexp_extract_all`` and their places from the lengths of the pieces that
``split`` leaves between them.

Rows: null text counts as empty and has no findings.  Repeated rows, and
paths with equal texts, share one scan and each get its findings; a null
path is kept.  Only the named path and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import scratch, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of one of the pattern's groups."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds in their order; patterns and least lengths are fixed values.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
SPAN = "array<struct<start:int,place:int,kind:string,stop:int>>"
ENTRY = f"blob binary, rules array<string>, spans {SPAN}"


def blob_id(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Places of the rule's matches in code points, those of failing matches left out."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(
        F.zip_with(between, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"))),
        judged,
        lambda s, g: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (F.length(g) >= rule.least).alias("good")),
    )

    def take(done, s):
        start = done["at"] + s["gap"]
        one = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (start + s["size"]).alias("stop"))
        return F.struct((start + s["size"]).alias("at"), F.when(s["good"], F.concat(done["spans"], F.array(one))).otherwise(done["spans"]).alias("spans"))

    empty = F.array().cast(SPAN)
    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")), take, lambda done: done["spans"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(empty)


class BlobLedger:
    """What was scanned and found, as Parquet parts below one folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, parts: list[str] | None = None):
        self.spark, self.root, self.parts = spark, root or scratch(spark, "blob-ledger"), list(parts or [])

    def entries(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*self.parts)

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the pairs of a blob of ``versions`` and a rule version that the ledger lacks."""
        blobs = versions.select(blob_id(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
        if self.parts:
            known = self.entries().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("known"))
            blobs = blobs.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        else:
            blobs = blobs.withColumn("known", F.array().cast("array<string>"))
        due = F.filter(F.array(*[F.lit(r.key) for r in rules]), lambda k: ~F.array_contains(F.col("known"), k))
        blobs = blobs.withColumn("rules", due).where(F.size("rules") > 0)
        each = [F.when(F.array_contains("rules", r.key), spans(F.col("body"), r, i)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules)]
        part = f"{self.root}/part-{len(self.parts)}"
        blobs.select("blob", "rules", F.concat(*each).alias("spans")).write.parquet(part)
        self.parts.append(part)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans in order) of the blobs in which the given rule versions found something.

        An older version's spans count only for a kind whose current version
        has not scanned the blob; ``scan`` leaves no such blob behind.
        """
        now = F.array(*[F.lit(r.key) for r in rules])
        current = F.transform(F.filter("rules", lambda k: F.array_contains(now, k)), lambda k: F.substring_index(k, "@", 1))
        own = self.entries().select("blob", F.filter("spans", lambda s: F.array_contains(current, s["kind"])).alias("spans")).where(F.size("spans") > 0)
        if len(self.parts) > 1:
            own = own.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a blob has one entry a rule version
        return own.select("blob", F.array_sort("spans").alias("spans"))


def report(versions: DataFrame, ledger: BlobLedger, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what is new in ``versions`` and return each path with its findings' spans."""
    ledger.scan(versions, text, rules)
    found = written(ledger.findings(rules), "secret-findings")
    paths = versions.select(F.col(path), blob_id(text).alias("blob"))
    return paths.join(found, "blob", "left").select(path, F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: findings of each kind, their spans as text, and its hash."""
    rows = report(docs, BlobLedger(docs.sparkSession))
    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    counts = [_count(r.kind).cast("long").alias(f"n_{r.kind}") for r in RULES]
    return rows.select("doc_id", *counts, listed.alias("spans")).withColumn("base_sha256", F.sha2("spans", 256))


_KINDS_SQL = "\n  UNION ALL ".join(
    f"SELECT {i} AS place, '{r.kind}' AS kind, id, unnest(regexp_extract_all(body, '{p}')) AS m, unnest(regexp_extract_all(body, '{p}', {r.group})) AS g, unnest(string_split_regex(body, '{p}')[:-2]) AS gap, unnest(range(len(regexp_extract_all(body, '{p}')))) AS k FROM texts"
    for i, r in enumerate(RULES)
    for p in [r.pattern.replace("'", "''")]
)
ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id AS id, coalesce(text, '') AS body FROM documents),
matches AS ({_KINDS_SQL}),
placed AS (
  SELECT place, kind, id, g, length(m) AS size, sum(length(gap) + length(m)) OVER (PARTITION BY id, place ORDER BY k) AS stop FROM matches),
good AS (
  SELECT id, place, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed
  WHERE length(g) >= CASE kind {' '.join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)} END),
listed AS (
  SELECT id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM good GROUP BY id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)},
  coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM documents d LEFT JOIN listed ON listed.id = d.doc_id
"""
