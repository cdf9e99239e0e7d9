"""WARC archives of pages, and the global capture index merged from locally sorted runs.

Writing. Every page becomes one WARC/1.1 record whose block is an HTTP message with the html as payload. Of the records with
equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page_id is a ``response``; the others are
``revisit`` records that refer to it and carry no payload. Archives are written by Spark's own text writer, compressed as
whole files, so they go to any store that Spark can write to; offsets count uncompressed bytes.

Reading. Archives are parsed by Content-Length, never by looking for separators, and digests are computed again. Each
archive yields a capture run that is sorted by URL key and timestamp and stored. The runs are cut by range of (URL key,
timestamp, page_id), so no key has to fit one task, and each range merges its pieces of all runs by a loser tree. A row's
``capture`` is its place in the merged order: the rows of the ranges before, and its place in its own.

Defined results: a null html is an empty payload, a null url is ``urn:none``; control characters in a URL are escaped; rows
that repeat a page_id and payload each give a record, all of the same type; a null page_id is kept, and never referred to;
an empty table gives no archives and an empty result; other columns are ignored. Archives are cut by the size of their
records, so that one is never larger than ``ARCHIVE_BYTES`` or one record.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 100
#: Records and bytes of an archive, at most, and rows that one range of the merge holds, about.
ARCHIVE_RECORDS, ARCHIVE_BYTES, RANGE_ROWS = 2_000, 256_000_000, 50_000
#: Bytes of a record besides its payload and its URL, at most.
HEAD_BYTES = 1_000
_EPOCH = 1_700_000_000


def first_captures(pages: DataFrame) -> DataFrame:
    """(digest, first): the smallest page_id of every payload that more than one row has, and that is large enough to refer to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.where((F.octet_length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", F.sha2("html", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def archive_records(pages: DataFrame, first: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """One column ``value``: the WARC record of each row of ``pages`` (page_id, url, html).

    With ``sizes`` (low, high) only records whose bound of bytes is above low and at most high. A row whose response is
    not among them goes without its html, as it can only be a revisit: so each html is shuffled once for all sizes.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("urn:none")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html")})
    if sizes is not None:
        short = F.octet_length("url") * 3 + HEAD_BYTES
        rows = rows.withColumns({"full_in": _within(short + F.col("bytes"), sizes), "short_in": _within(short, sizes)}).where("full_in or short_in")
        rows = rows.withColumn("html", F.when(F.col("full_in"), F.col("html")))
    rows = rows.join(first, "digest", "left").withColumn("refers", F.expr("if(first is not null and page_id is distinct from first, first, null)"))
    if sizes is not None:
        rows = rows.where("if(refers is null, full_in, short_in)")
    for raw, safe in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        rows = rows.withColumn("url", F.replace("url", F.lit(raw), F.lit(safe)))
    rows = rows.withColumn("url", F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""))
    second = F.expr(f"{_EPOCH} + coalesce(page_id, 0)")
    day = F.date_format(F.expr(f"date_from_unix_date(CAST(({_EPOCH} + coalesce(page_id, 0)) div 86400 AS INT))"), "yyyy-MM-dd")
    parts = [F.lpad((F.pmod(second, F.lit(wide)) / tall).cast("long").cast("string"), 2, "0") for wide, tall in ((86_400, 3_600), (3_600, 60), (60, 1))]
    stamp = F.concat(day, F.lit("T"), F.concat_ws(":", *parts), F.lit("Z"))  # UTC, whatever the session's zone is
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("refers").isNull(), F.col("html")).otherwise(""))
    kind = F.when(F.col("refers").isNull(), "response").otherwise("revisit")
    ident = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers"), F.lit(">\r\n"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), ident, F.lit("\r\nWARC-Date: "), stamp, F.lit("\r\nWARC-Target-URI: "), F.col("url"),
            F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"), F.coalesce(revisit, F.lit("")),
            F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"), block,
        ).alias("value")
    )


def _within(size, sizes: tuple[int, int]):
    return (size > sizes[0]) & (size <= sizes[1])


def write_archives(pages: DataFrame, path: str) -> None:
    """Records of up to ``ARCHIVE_BYTES / ARCHIVE_RECORDS`` bytes, most often all, in one go; larger ones by power of 8, fewer to an archive."""
    least = ARCHIVE_BYTES // ARCHIVE_RECORDS
    bound = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(8)) * 3 + HEAD_BYTES
    longest = pages.agg(F.max(bound)).first()[0] or 0
    first, kept = common.stored(first_captures(pages), "warc-first")
    low, high = -1, least
    while low < longest:
        many = max(1, min(ARCHIVE_RECORDS, ARCHIVE_BYTES // high))
        part = archive_records(pages, first, None if longest <= least else (low, high))
        part.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", many).option("compression", "gzip").text(path)
        low, high = high, high * 8
    common.drop_path(pages.sparkSession, kept)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)


def parse(archive: bytes):
    """(offset, length, WARC fields, HTTP fields, payload) of every record."""
    at = 0
    while at < len(archive):
        cut = archive.index(b"\r\n\r\n", at)
        head = _fields(archive[at:cut])
        start = cut + 4
        end = start + int(head[b"Content-Length"])
        if not archive.startswith(b"WARC/", at) or archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        block = archive[start:end]
        split = block.index(b"\r\n\r\n")
        yield at, end + 4 - at, head, _fields(block[:split]), block[split + 4 :]
        at = end + 4


def url_key(url: str) -> str:
    """Host labels reversed, then the rest: captures of a site sort together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^@/?#]*@)?([^/:?#]*)(?::\d+)?([^#]*)", url, re.IGNORECASE)
    if not m:
        return url
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


RUN = "run string, seq long, url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"
_NAMES = [c.split()[0] for c in RUN.split(", ")]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives in ``path``, those of one archive sorted by URL key, timestamp and page."""

    def page(raw: bytes) -> int | None:
        name = raw.removeprefix(b"<urn:page:").removesuffix(b">")
        return None if name == b"none" else int(name)

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for offset, length, head, http, payload in parse(gzip.decompress(content.as_py())):
                    digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
                    kind = head[b"WARC-Type"].decode()
                    if kind == "response" and (len(payload) != int(http[b"Content-Length"]) or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of the record at byte {offset} of {name} is damaged")
                    refers = head.get(b"WARC-Refers-To")
                    rows.append((url_key(head[b"WARC-Target-URI"].decode()), head[b"WARC-Date"].decode(), page(head[b"WARC-Record-ID"]), int(http[b"Content-Length"]), digest, kind, page(refers) if refers else None, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2]))
                rows = [(name.as_py(), k, *r) for k, r in enumerate(rows)]
                columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, RUN)


def loser_tree(runs: list[list]):
    """The rows of sorted ``runs`` in order; each step replays one leaf-to-root path of the losers' tree."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    head = [run[0] if run else None for run in runs]

    def wins(a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0
        if head[a] is None or head[b] is None:
            return head[a] is not None or (head[b] is None and a < b)
        return (head[a], a) < (head[b], b)

    loser = [-1] * k  # inner nodes 1..k-1; leaf i is node k + i; -1 beats all until every leaf has played
    winner = -1
    for i in range(k):
        champ, node = i, (k + i) // 2
        while node:
            if wins(loser[node], champ):
                loser[node], champ = champ, loser[node]
            node //= 2
        winner = champ
    while winner >= 0 and head[winner] is not None:
        yield winner, at[winner]
        at[winner] += 1
        run = runs[winner]
        head[winner] = run[at[winner]] if at[winner] < len(run) else None
        champ, node = winner, (k + winner) // 2
        while node:
            if wins(loser[node], champ):
                loser[node], champ = champ, loser[node]
            node //= 2
        winner = champ


def merged(runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, timestamp and page, with their places in it (``capture``, from 0)."""
    parts = max(1, runs.count() // RANGE_ROWS)
    pieces = runs.repartitionByRange(parts, "url_key", "ts", "page_id").sortWithinPartitions("run", "seq")

    def merge(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        run, *key = (table[c].to_pylist() for c in ("run", "url_key", "ts", "page_id"))
        key = [(u, t, p is not None, p or 0) for u, t, p in zip(*key)]
        cuts = [0, *(k for k in range(1, len(run)) if run[k] != run[k - 1]), len(run)]
        order = [cuts[r] + k for r, k in loser_tree([key[a:b] for a, b in zip(cuts, cuts[1:])])]
        table = table.take(pa.array(order)).append_column("range", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
        yield from table.append_column("place", pa.array(range(len(order)), pa.int64())).to_batches(max_chunksize=10_000)

    rows, _ = common.stored(pieces.mapInArrow(merge, f"{RUN}, range int, place long"), "warc-merged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(sizes), "range").withColumn("capture", F.col("first") + F.col("place")).drop("range", "place", "first")


def capture_index(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archives of ``pages`` written to ``path`` (in the shared folder if unset), read back and merged."""
    path = path or common.new_path(spark, "warc")
    write_archives(pages, path)
    runs, _ = common.stored(capture_runs(spark, path), "warc-runs")
    return merged(runs)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index(spark, common.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "capture")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  regexp_extract(coalesce(url, 'urn:none'), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^@/?#]*@)?([^/:?#]*)(?::[0-9]+)?([^#]*)', ['host', 'rest']) AS u, coalesce(url, 'urn:none') AS url,
  strftime(to_timestamp(1700000000 + coalesce(page_id, 0))::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM pages),
k AS (SELECT page_id, ts, CASE WHEN NOT regexp_matches(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//') THEN url
  ELSE array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www\\.', ''), '.')), ',') || ')' || CASE WHEN u.rest = '' THEN '/' ELSE u.rest END END AS url_key FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY url_key, ts, page_id) - 1 AS capture FROM k),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, url_key, o.ts, capture
FROM p LEFT JOIN f USING (payload_digest) JOIN o USING (page_id)
"""
