"""WARC archives and the external merge of their index.

Captures are written as gzip-per-record WARC files, one or more by each
task, each of bounded size.  A payload seen more than once is stored by one
response record; the others are revisit records that refer to it.  Files
come from tasks that may run again, so a file counts only when the manifest,
a table that Spark commits, names it.

Reading gives each archive's captures as a run sorted by URL key and time.
The key space is cut into ranges, every range receives its slice of each
run, and a loser tree merges the slices, so the ranges one after the other
are the captures in global order: each URL's history.  Page id, run and
place in the run break ties, which lets a range boundary fall inside the
history of one URL.

Rows: null html is an empty payload; a null URL has the empty key; a null
page id is kept, never responds for another page that has an id, and repeated
rows are each a record.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import scratch, written

#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 0
#: An archive is closed at so many bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 128 << 20, 50_000
#: Captures that one merge task gets, about.
RANGE_ROWS = 50_000
#: Seconds since 1970 of page 0's capture; page n follows n seconds later (pages carry no time).
EPOCH = 1_700_000_000


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host labels, path and query; no scheme, port, ``www`` or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.strip().lower()
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def _line(name: str, value) -> bytes:
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {text}\r\n".encode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _date(seconds: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url, seconds: int, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) has the HTTP head only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", len(payload)) + b"\r\n" + (b"" if revisit else payload)
    head = [b"WARC/1.1\r\n", _line("WARC-Type", "revisit" if revisit else "response"), _line("WARC-Record-ID", _record_id(page_id)), _line("WARC-Date", _date(seconds))]
    if url is not None:
        head.append(_line("WARC-Target-URI", url))
    head += [_line("WARC-Payload-Digest", f"sha1:{digest}"), _line("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        head.append(_line("X-Page-Id", page_id))
    if revisit:
        head += [_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), _line("WARC-Refers-To", _record_id(refers_to)), _line("X-Refers-To-Page-Id", refers_to)]
    head.append(_line("Content-Length", len(block)))
    return b"".join([*head, b"\r\n", block, b"\r\n\r\n"])


def parse(raw: bytes) -> dict:
    """Fields of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page is None else int(page),
        "url_key": url_key(fields.get("WARC-Target-URI")),
        "captured_at": fields["WARC-Date"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
    }


def members(stream, chunk: int = 1 << 20):
    """The decompressed members of a gzip stream, one at a time."""
    tail = b""
    while True:
        tail = tail or stream.read(chunk)
        if not tail:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not tail and not (tail := stream.read(chunk)):
                raise EOFError("archive ends inside a record")
            parts.append(inflate.decompress(tail))
            tail = inflate.unused_data
        yield b"".join(parts)


def _open(uri: str):
    """File system and path of a URI, for tasks."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Captures (page_id, url, seconds, payload, refers_to); of equal payloads the largest page id responds."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"))
    big = F.octet_length("payload") >= least
    shared = rows.where(big).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("response").isNotNull())
    shared = written(shared.select("digest", "response"), "warc-shared")
    joined = rows.join(shared, "digest", "left")
    again = F.when(big & ~F.col("response").eqNullSafe(F.col("page_id")), F.col("response"))
    return joined.select("page_id", "url", (F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))).alias("seconds"), "payload", again.alias("refers_to"))


def write(captures: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write the captures as archives below ``root``; returns the manifest (archive, records, bytes)."""
    import pyarrow as pa

    def run(batches):
        out, made = None, []

        def close():
            nonlocal out
            if out:
                out[1].close()
                made.append((out[0], out[2], out[3]))
                out = None

        for batch in batches:
            for page, url, seconds, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "seconds", "payload", "refers_to")), strict=True):
                if out is None:
                    uri = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    system, path = _open(uri)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = [uri, system.open_output_stream(path, compression=None), 0, 0]
                member = gzip.compress(record(page, url, seconds, payload.encode(), refers), compresslevel=3, mtime=0)
                out[1].write(member)
                out[2] += 1
                out[3] += len(member)
                if out[2] >= archive_records or out[3] >= archive_bytes:
                    close()
        close()
        if made:
            names, records, sizes = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(records, type=pa.int64()), pa.array(sizes, type=pa.int64())], names=["archive", "records", "bytes"])

    return written(captures.mapInArrow(run, "archive string, records bigint, bytes bigint"), "warc-manifest")


CAPTURE = "page_id bigint, url_key string, captured_at string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _key(row: dict) -> tuple:
    return row["url_key"], row["captured_at"], -1 if row["page_id"] is None else row["page_id"]


def read_runs(manifest: DataFrame) -> DataFrame:
    """The archives' captures: each archive is a run, sorted by URL key, time and page, with the places numbered."""
    import pyarrow as pa

    names = [x.split()[0] for x in CAPTURE.split(", ")]

    def run(batches):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                system, path = _open(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    rows = sorted(map(parse, members(stream)), key=_key)  # an archive has a bounded number of records
                cols = [pa.array([r[n] for r in rows], type=pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([uri] * len(rows)), pa.array(range(len(rows)), type=pa.int64())], names=[*names, "run", "place"])

    tasks = max(1, manifest.count())
    return manifest.select("archive").repartition(tasks).mapInArrow(run, f"{CAPTURE}, run string, place bigint")


class LoserTree:
    """Merges sorted sequences: inner nodes hold the loser of their match, the root the winner."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.loser = [-1] * max(1, self.k)
        self.best = self._play(1) if self.k > 1 else 0

    def _head(self, run: int):
        i = self.at[run]
        return (0, self.runs[run][i], run) if i < len(self.runs[run]) else (1, (), run)

    def _play(self, node: int) -> int:
        """Winner of the subtree; leaves are numbered from ``k``."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._head(a) <= self._head(b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self):
        if not self.k:
            return
        while True:
            win = self.best
            done, key, _ = self._head(win)
            if done:
                return
            yield win, self.at[win]
            self.at[win] += 1
            node = (win + self.k) // 2
            while node >= 1 and self.k > 1:
                if self._head(self.loser[node]) < self._head(win):
                    self.loser[node], win = win, self.loser[node]
                node //= 2
            self.best = win


def merge(runs: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in global order: ``range_no`` and the ``position`` in it number them."""
    import pyarrow as pa

    n = max(8, -(-rows // range_rows))
    dealt = runs.repartitionByRange(n, "url_key", "captured_at", F.coalesce("page_id", F.lit(-1)), "run", "place")

    def run(batches):
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches)) if batches else None  # a range has about range_rows captures
        if table is None or not table.num_rows:
            return
        cols = {c: table.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id", "run")}
        slices: dict[str, list[int]] = {}
        for i, r in enumerate(cols["run"]):
            slices.setdefault(r, []).append(i)
        order = sorted(slices)
        keys = [[(cols["url_key"][i], cols["captured_at"][i], -1 if cols["page_id"][i] is None else cols["page_id"][i]) for i in slices[r]] for r in order]
        took = [slices[order[r]][i] for r, i in LoserTree(keys)]
        merged = table.take(pa.array(took)).combine_chunks()
        part = pa.array([TaskContext.get().partitionId()] * len(took), type=pa.int32())
        out = merged.drop_columns(["run", "place"]).append_column("range_no", part).append_column("position", pa.array(range(len(took)), type=pa.int64()))
        yield from out.to_batches()

    return dealt.sortWithinPartitions("run", "place").mapInArrow(lambda batches: run(list(batches)), f"{CAPTURE}, range_no int, position bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their index."""
    manifest = write(plan(pages), scratch(pages.sparkSession, "warc"))
    rows = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    return merge(read_runs(manifest), rows)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
s AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(p.h, CAST(5 * i + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * j AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN s USING (h)
"""
