import base64
import hashlib
import random

import pytest

from cohortlens.llm import warc
from cohortlens.llm.common import scratch

PAGES = [
    (1, "http://www.example.org/b?x=1#f", "<p>one</p>"),
    (2, "https://example.org/a", "<p>one</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "http://[broken", "é漢\r\n\r\nbody"),
    (None, "http://example.org/a", "<p>one</p>"),
    (6, "http://example.org/a", "x" * 3_000_000),
    (7, "http://example.org/twice\r\nX: y", "same row"),
    (7, "http://example.org/twice\r\nX: y", "same row"),
]
SCHEMA = "page_id bigint, url string, html string"


def pages(spark, rows=PAGES):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("digest", "payload", "response", "run", "n")])


def brute(rows):
    best = {}
    for page, _, html in rows:
        if page is not None:
            best[html or ""] = max(page, best.get(html or "", page))
    out = []
    for page, _, html in rows:
        raw, top = (html or "").encode(), best.get(html or "")
        again = top is not None and top != page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    return out


def test_round_trip_of_awkward_pages(spark):
    out = warc.round_trip(pages(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, out), key=str) == sorted(brute(PAGES), key=str)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_global_order_over_many_archives(spark):
    rnd = random.Random(1)
    rows = [(i, f"http://{rnd.choice('abc')}.example.org/{rnd.randrange(5)}", f"p{i % 40}") for i in range(500)]
    manifest = warc.write(warc.plan(pages(spark, rows).repartition(6)), scratch(spark, "warc"), archive_records=20)
    assert manifest.count() >= 25
    out = warc.merge(warc.read_runs(manifest), 500, range_rows=60).collect()
    ordered = sorted(out, key=lambda r: (r["range_no"], r["position"]))
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys) and len(keys) == 500 and len({r["range_no"] for r in out}) > 1


def test_loser_tree():
    rnd = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rnd.choices(range(20), k=rnd.randrange(9))) for _ in range(k)]
        keyed = [[(x,) for x in r] for r in runs]
        got = [runs[r][i] for r, i in warc.LoserTree(keyed)]
        assert got == sorted(x for r in runs for x in r)


def test_damaged_payload_is_refused():
    raw = warc.record(1, "http://a/", 0, b"payload", None)
    assert warc.parse(raw)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npayloae"))
