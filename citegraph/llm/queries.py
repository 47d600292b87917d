"""The operators applied to whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm import decontaminate, langid, licenses, media, mixing, neardup, pii, reshard, substring, warc
from citegraph.llm.shared import documents


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the least doc_id of its near-duplicate class), kept."""
    classes = neardup.near_duplicate_classes(documents(spark, sf_dir))
    return classes.select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))).alias("kept"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return substring.strip_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_windows, n_exact of every document and benchmark item that share a template window."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    return langid.predict(docs, langid.train(docs.filter("not held_out")), "doc_id", "held_out")


def op2_mincost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard; 16 shards of near-equal bytes from a layout by source."""
    placed, _ = reshard.reshard(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, part, position."""
    return mixing.mix(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return pii.digest(pii.personal_data(documents(spark, sf_dir), "doc_id"))


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records of pages: each was fetched at the time of its number and asked for again 1,000 later, when the server said not modified."""
    etag, sha = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.sha1(F.col("html").cast("binary"))
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("time"), F.lit("response").alias("type"), sha.alias("digest"), etag.alias("etag"), F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit("text/html")).alias("headers"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 1000).alias("time"), F.lit("revisit").alias("type"), sha.alias("digest"), etag.alias("etag"), F.create_map(F.lit("etag"), etag, F.lit("content-length"), F.lit("0")).alias("headers"))
    return full.unionByName(again).withColumn("last_modified", F.lit(None).cast("string"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id of each revisit, url, status, response_page, digest, header_names."""
    done = warc.resolve(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    half = lambda c: F.floor((F.col(c) - F.col(c) % 2) / 2).cast("long")
    return done.select(half("record_id").alias("page_id"), "url", "status", half("response_id").alias("response_page"), "digest", F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("header_names"))


OP4_SQL = r"""
with cut as (select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from pages),
split as (
  select page_id, html,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.|\.$', '') as host,
    regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/(index|default)\.(html?|php|aspx?)$', '/'), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)'))) as query
  from cut),
named as (select page_id, html, host || path || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end as url from split),
records as (
  select page_id, url, page_id as time, true as is_full, sha1(html) as digest from named
  union all select page_id, url, page_id + 1000, false, sha1(html) from named),
joined as (
  select *, max(case when is_full then page_id end) over (partition by url order by time range between unbounded preceding and 1 preceding) as found from records)
select j.page_id, j.url, case when n.page_id is null then 'unresolved' when sha1(n.html) = j.digest then 'resolved' else 'contradicted' end as status,
  case when sha1(n.html) = j.digest then n.page_id end as response_page, j.digest,
  case when sha1(n.html) = j.digest then 'content-type,etag' else 'content-length,etag' end as header_names
from joined j left join named n on n.page_id = j.found where not j.is_full
"""


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, class_id, n_corners of the embeddings drawn as images."""
    return media.copies(media.vector_images(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).withColumnRenamed("image_id", "vec_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, license, score, origin, licensed_by; documents lie in directories by source and number, every seventh as a licence file."""
    d = documents(spark, sf_dir)
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit("LICENSE.")).otherwise(F.lit("")), F.col("doc_id").cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 50).cast("string"), name)
    files = d.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    return licenses.scan(files, "doc_id", "path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mincost_reshard": op2_mincost_reshard,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_image_copies": op7_image_copies,
    "op8_license_scan": op8_license_scan,
    "op9_personal_data": op9_personal_data,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: All pairs of texts that share a shingle, and the least id along their links.
OP3_SQL = rf"""
with recursive texts as (select coalesce(text, '') as body, min(doc_id) as id, md5(coalesce(any_value(text), '')) as key from documents group by 1),
cut as (select id, {_WORDS.replace("text", "body")} as w from texts),
shingles as (
  select id, case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end as s from cut where len(w) > 0),
bags as (select id, s, count(*) as n from (select id, unnest(s) as s from shingles) group by id, s),
sizes as (select id, sum(n) as size from bags group by id),
pairs as (select a.id as a, b.id as b, sum(least(a.n, b.n)) as both_ from bags a join bags b on a.s = b.s and a.id < b.id group by a.id, b.id),
links as (select a, b from pairs p join sizes x on x.id = p.a join sizes y on y.id = p.b where both_ >= 0.8 * (x.size + y.size - both_) - 1e-6),
ways as (select a, b from links union all select b, a from links),
reached(id, other) as (select id, id from texts union select r.id, w.b from reached r join ways w on w.a = r.other),
named as (select id, min(other) as class_id from reached group by id)
select d.doc_id, n.class_id, d.doc_id = n.class_id as kept from documents d join texts t on t.body = coalesce(d.text, '') join named n on n.id = t.id
"""

#: Every window of every text, counted.
OP5_SQL = rf"""
with cut as (select doc_id, {_WORDS} as w from documents),
windows as (select doc_id, unnest(range(1, len(w) - 33)) as begins, w from cut where len(w) >= 35),
hashed as (select doc_id, begins, md5(array_to_string(w[begins:begins+34], ' ')) as h from windows),
again as (select h from hashed group by h having count(*) > 1),
gone as (select distinct doc_id, begins + j as place from hashed join again using (h) cross join range(0, 35) t(j)),
places as (select doc_id, list(place) as places, count(*) as n from gone group by doc_id),
kept as (select c.doc_id, len(c.w) as n_words, coalesce(p.n, 0) as n_removed, case when p.n is null then c.w else list_filter(c.w, lambda x, i: not list_contains(p.places, i)) end as k from cut c left join places p on p.doc_id = c.doc_id)
select doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""

ORACLE_SQL: dict[str, str] = {"op3_minhash_near_dedup": OP3_SQL, "op4_warc_revisits": OP4_SQL, "op5_substring_dedup": OP5_SQL}
