"""Registered queries of the corpus operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import bpe, conversation_trie, decontam, exact_dedup, hpylm, langid, line_dedup, merkle, near_dup, quality_crf, secrets, substring_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> str:
    """The rank table of the public tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pitman_yor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.report(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), rank_file())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_crf.judge(docs, quality_crf.fit(docs, _table(spark, sf_dir, "labels")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.report(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_table(spark, sf_dir, "documents"))


SPACE_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH lines AS (
  SELECT row, doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM (
    SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, {LOWER_SQL.format(f"trim(line, {SPACE_SQL})")} AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (key NOT IN (FROM often)), '')) AS kept_sha256
FROM keyed GROUP BY row, doc_id
"""

WORDS_SQL = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP7_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS_SQL.format(LOWER_SQL.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
arcs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, arcs.y FROM reach JOIN arcs ON arcs.x = reach.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON x = doc_id
"""

OP10_SQL = f"""
WITH docs AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM starts JOIN docs USING (doc_id)),
again AS (SELECT doc_id, i FROM windows WHERE g IN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(35) AS r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (
  SELECT doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {LOWER_SQL.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, row) = 1 AS kept, sha256(t) AS text_sha256
FROM docs
"""

#: CRC-32 of an integer column's decimal digits: bytes are taken in one after the other, eight shifts each.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(coalesce({0}::VARCHAR, ''), ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""

OP12_SQL = f"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS k, name, size FROM (
    SELECT conv_id, turn, substr(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32) AS name, length(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS home, {CRC_SQL.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, k, name, size FROM convs c JOIN turns t ON t.conv_id = c.home AND k <= h
  UNION ALL SELECT c.conv_id, k, name, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND k > h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, name, size FROM built),
prefixes AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS p, NULL::VARCHAR AS parent, 0::BIGINT AS size FROM convs
  UNION ALL SELECT n.conv_id, n.d, sha256(concat(x.p, n.name)), x.p, n.size FROM prefixes x JOIN numbered n ON n.conv_id = x.conv_id AND n.d = x.d + 1),
nodes AS (SELECT p, min(d) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM prefixes GROUP BY p),
children AS (SELECT parent AS p, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
within AS (
  SELECT DISTINCT a.p AS top, b.p AS p FROM prefixes a JOIN prefixes b ON b.conv_id = a.conv_id AND b.d >= a.d),
sums AS (
  SELECT top, count(*) FILTER (children.n IS NULL) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
  FROM within JOIN nodes USING (p) LEFT JOIN children USING (p) GROUP BY top),
ends AS (
  SELECT p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM prefixes x
  WHERE d = (SELECT max(d) FROM prefixes y WHERE y.conv_id = x.conv_id) GROUP BY p)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(children.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums ON top = n.p LEFT JOIN nodes up ON up.p = n.parent LEFT JOIN children ON children.p = n.p LEFT JOIN ends ON ends.p = n.p
"""


def _merkle_sql() -> str:
    """One step of a recursion a level: first within languages, then over them; a node keeps its digest while its group waits."""
    field = lambda c: f"coalesce(concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR), '-')"
    leaf = lambda n_chars: "sha256(concat(" + ", ".join(field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + "))"
    tree = lambda name, source: f"""
{name} AS (
  SELECT * FROM {source}
  UNION ALL
  SELECT grp, level + 1, i // 2, CASE WHEN n > 1 THEN sha256(concat(h, coalesce(lead(h) OVER pair, ''))) ELSE h END, (n + 1) // 2
  FROM {name} WHERE n > 1 WINDOW pair AS (PARTITION BY grp, i // 2 ORDER BY i) QUALIFY row_number() OVER pair = 1)"""
    climb = lambda name, start, tree: f"""
{name} AS (
  SELECT * FROM {start}
  UNION ALL
  SELECT row, c.grp, c.level + 1, c.i // 2, concat(sibs, coalesce(s.h, '')), sha256(CASE WHEN s.h IS NULL THEN f WHEN s.i < c.i THEN concat(s.h, f) ELSE concat(f, s.h) END)
  FROM {name} c JOIN {tree} t ON t.grp = c.grp AND t.level = c.level AND t.i = c.i
  LEFT JOIN {tree} s ON s.grp = c.grp AND s.level = c.level AND s.i = xor(c.i, 1) WHERE t.n > 1)"""
    last = lambda name, key: f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY level DESC) = 1)"
    return f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('v' || lang, '') AS grp, {leaf("n_chars")} AS leaf,
    CASE WHEN {CRC_SQL.format("doc_id")} % 7 = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS seen FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM docs),
leaves AS (SELECT grp, 0 AS level, i, leaf AS h, n FROM placed),
{tree("lower_tree", "leaves")},
subroots AS (SELECT grp, h FROM {last("lower_tree", "grp")}),
heads AS (SELECT 'all' AS grp, 0 AS level, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, h, count(*) OVER () AS n FROM subroots),
{tree("upper_tree", "heads")},
first_steps AS (SELECT row, grp, 0 AS level, i, '' AS sibs, seen AS f FROM placed),
{climb("lower_climb", "first_steps", "lower_tree")},
met AS (SELECT c.row, 'all' AS grp, 0 AS level, g.i, sibs, f FROM {last("lower_climb", "row")} c JOIN (SELECT grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS i FROM subroots) g USING (grp)),
{climb("upper_climb", "met", "upper_tree")},
root AS (SELECT h FROM {last("upper_tree", "grp")})
SELECT doc_id, leaf, subroots.h AS subroot, root.h AS root, sha256(u.sibs) AS proof_sha256, u.f AS folded_root, u.f = root.h AS verified
FROM docs JOIN subroots USING (grp), root, {last("upper_climb", "row")} u WHERE u.row = docs.row
"""


QUERIES = {
    "op1_secret_scan": (op1_secret_scan, secrets.ORACLE_SQL),
    "op2_warc_index_merge": (op2_warc_index_merge, warc.ORACLE_SQL),
    "op3_benchmark_decontamination": (op3_benchmark_decontamination, None),
    "op4_pitman_yor_scoring": (op4_pitman_yor_scoring, None),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_line_dedup": (op6_line_dedup, OP6_SQL),
    "op7_minhash_near_dedup": (op7_minhash_near_dedup, OP7_SQL),
    "op8_language_id": (op8_language_id, None),
    "op9_quality_rules": (op9_quality_rules, None),
    "op10_substring_dedup": (op10_substring_dedup, OP10_SQL),
    "op11_exact_dedup": (op11_exact_dedup, OP11_SQL),
    "op12_conversation_trie": (op12_conversation_trie, OP12_SQL),
    "op13_merkle_manifest": (op13_merkle_manifest, _merkle_sql()),
}
