"""WARC not-modified revisits: each resolves to the latest earlier full response of its canonical URL.

The as-of join works on one row for each URL and time, in slices of time, so that
no task holds all captures of a URL that a third of the corpus may have:
within a slice a running last, across slices the last of those before.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.llm.shared import by_value, written

by_value(__name__)

#: Captures (rows of one URL and time) that a slice of time aims at.
SLICE_ROWS = 200_000
#: Beyond so many slices they take more rows instead; their sorts spill.
MAX_SLICES = 10_000
#: Header fields that a not-modified response may bring up to date; the rest, above all those on the body, are the stored response's.
MERGED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "link", "vary", "warning")
#: Query parameters that name a visit, not a page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)"


def canonical_url(url: Column) -> Column:
    """One form for the ways to write an address: no scheme, user, "www.", default port, fragment or tracking parameters; lower-case host; parameters sorted; no trailing slash or index page. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(?:80|443)$", ""), r"^www\d*\.|\.$", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/(?:index|default)\.(?:html?|php|aspx?)$", "/"), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(F.lower(p), F.lit(rf"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def _slices(moments: DataFrame, rows: int) -> DataFrame:
    """`moments` (url, time, ...), a written table, with slice: the times of all URLs together in about equal ranges, equal times in one."""
    parts = min(MAX_SLICES, max(1, -(-moments.count() // rows)))
    if parts == 1:
        return moments.withColumn("slice", F.lit(0))
    return moments.repartitionByRange(parts, "time").withColumn("slice", F.spark_partition_id())


def resolve(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The revisits of `records` with the response they stand for.

    `records` has record_id (long), url, time (long, e.g. microseconds), type
    ("response" or "revisit"), digest (of the payload), etag, last_modified and
    headers (map of lower-case names); more columns are ignored.  The result has
    for each revisit record_id, url (canonical), time, status, response_id,
    response_time, digest and headers.  Status is

    - "resolved": there is an earlier response and no validator contradicts it;
    - "contradicted": the digests differ, or else, where one is missing, the entity
      tags (weakly compared), or else the dates of last modification;
    - "unresolved": no earlier response of that URL, or no url or time.

    Earlier means a smaller time; of several responses at one time the greatest
    record_id counts.  A response without an id or time is none.  Headers are the
    response's, with the fields of MERGED that the revisit has put in their place;
    those of a contradicted or unresolved revisit are its own.  Repeated rows are
    resolved each; an empty table gives an empty one.
    """
    seen = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("time").cast("long").alias("time"), F.col("type"), "digest", "etag", "last_modified", "headers")
    seen = written(seen.withColumn("full", F.coalesce(F.col("type") == "response", F.lit(False)) & F.col("record_id").isNotNull()), "captures")
    placed = seen.filter("url is not null and time is not null")
    at = placed.groupBy("url", "time").agg(F.max(F.when(F.col("full"), F.col("record_id"))).alias("full_id"), F.max((~F.col("full")).cast("int")).alias("asked"))
    at = written(at, "moments")
    # Written again, so that every reader sees the same cuts.
    at = written(_slices(at, slice_rows), "slices")
    last = F.when(F.col("full_id").isNotNull(), F.struct("time", F.col("full_id").alias("id")))
    ends = at.filter("full_id is not null").groupBy("url", "slice").agg(F.max(last).alias("end"))
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = at.groupBy("url", "slice").agg(F.max("asked").alias("asked")).join(ends, ["url", "slice"], "left").withColumn("carried", F.max("end").over(before)).filter("asked = 1").select("url", "slice", "carried")
    inside = Window.partitionBy("url", "slice").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    known = at.withColumn("near", F.max(last).over(inside)).filter("asked = 1").join(slices, ["url", "slice"])
    known = written(known.select("url", "time", F.coalesce("near", "carried").alias("found")).filter("found is not null").select("url", "time", F.col("found.id").alias("response_id"), F.col("found.time").alias("response_time")), "known")

    # One row for each response that some revisit needs; ids may repeat, so url and time belong to the key.
    needed = known.select(F.col("response_id").alias("record_id"), "url", F.col("response_time").alias("time")).distinct()
    bodies = placed.filter("full").join(needed, ["record_id", "url", "time"], "left_semi").groupBy("record_id", "url", "time").agg(F.max(F.struct("digest", "etag", "last_modified", F.map_entries("headers").alias("headers"))).alias("r"))
    asked = seen.filter(~F.col("full") & F.coalesce(F.col("type") == "revisit", F.lit(False)))
    full = known.join(bodies.select(F.col("record_id").alias("response_id"), "url", F.col("time").alias("response_time"), "r"), ["response_id", "url", "response_time"])
    both = asked.join(full, ["url", "time"], "left")

    def weak(tag: Column) -> Column:
        return F.regexp_replace(F.trim(tag), r'^[Ww]/', "")

    agrees = F.coalesce(F.col("digest") == F.col("r.digest"), weak(F.col("etag")) == weak(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"), F.lit(True))
    status = F.when(F.col("r").isNull(), "unresolved").when(agrees, "resolved").otherwise("contradicted")
    out = both.withColumn("status", status)
    good = F.col("status") == "resolved"
    new = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(*MERGED))
    old = F.map_filter(F.coalesce(F.map_from_entries("r.headers"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return out.select(
        "record_id", "url", "time", "status", F.when(good, F.col("response_id")).alias("response_id"), F.when(good, F.col("response_time")).alias("response_time"),
        F.when(good, F.coalesce("r.digest", "digest")).otherwise(F.col("digest")).alias("digest"), F.when(good, F.map_concat(new, old)).otherwise(F.col("headers")).alias("headers"),
    )


def _records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every WARC record; a record cut short at the end is left out."""
    at = 0
    while (begin := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", begin)
        if end < 0:
            return
        lines = raw[begin:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        if end + 4 + size > len(raw):
            return
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(warc_id, url, time in microseconds, type, digest, etag, last_modified, headers, body) of the response and revisit records of WARC files, gzipped by record or not; one file is one task."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime

        schema = pa.schema([("warc_id", pa.string()), ("url", pa.string()), ("time", pa.int64()), ("type", pa.string()), ("digest", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
        for batch in batches:
            for raw in batch.column(0):
                data = raw.as_py() or b""
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = []
                for fields, block in _records(data):
                    if fields.get("warc-type") not in ("response", "revisit"):
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
                    headers = {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}
                    try:
                        moment = datetime.datetime.fromisoformat(fields.get("warc-date", "").replace("Z", "+00:00"))
                        time = round((moment - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) / datetime.timedelta(microseconds=1))
                    except (ValueError, TypeError):
                        time = None
                    rows.append({"warc_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "time": time, "type": fields["warc-type"], "digest": fields.get("warc-payload-digest"), "etag": headers.get("etag"), "last_modified": headers.get("last-modified"), "headers": list(headers.items()), "body": body if fields["warc-type"] == "response" else None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, "warc_id string, url string, time long, type string, digest string, etag string, last_modified string, headers map<string,string>, body binary")
