"""Queries of sources and sinks: payloads read as rows, upserts, replacement per key, caches and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import archive_path, normal_cik
from lodestrata.operators.tables import long_cells
from lodestrata.session import cut, table
from lodestrata.sources import readers, sinks
from lodestrata.streaming import intake

#: Ids that one payload page of filings covers, and so the most rows that a page holds.
PAGE = 1000
#: Reports of a registrant that the short index lists.
FIRST = 5
SPLIT = "timestamp '2031-06-01 00:00:00'"


def open_data(spark: SparkSession, d: str) -> DataFrame:
    """Reports read from the payloads they came with."""
    return readers.open_data_reports(table(spark, d, "reports").select("raw")).select("external_id", "category", "status", "lat", "lon")


def image_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Images written as the API's JSON and read back."""
    i = table(spark, d, "images").select(
        F.to_json(F.struct(F.col("external_id").alias("id"), F.unix_millis("captured_at").alias("captured_at"), "width", "height", "compass_angle", F.col("storage_path").alias("thumb_1024_url"))).alias("raw")
    )
    return readers.street_images(i)


def filing_index_all(spark: SparkSession, d: str) -> DataFrame:
    """Filings in column-wise payloads per registrant, year and page, read back as rows: all annual and quarterly reports.

    pos counts a registrant's filings of a year of any form. A page covers PAGE ids, and starts where the pages before it end.
    """
    f = table(spark, d, "filings").filter("cik is not null and filed_at is not null")
    names = {"accession": "accessionNumber", "form": "form", "filed_at": "filingDate", "period_end": "reportDate", "raw_path": "primaryDocument", "title": "primaryDocDescription", "kind": "items"}
    rows = f.select("cik", F.year("filed_at").alias("y"), F.coalesce(F.floor(F.col("id") / PAGE), F.lit(-1)).alias("page"), F.struct("id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in names.items()]).alias("r"))
    page = rows.groupBy("cik", "y", "page").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    sizes = rows.groupBy("cik", "y", "page").agg(F.count("*").alias("n"))  # one narrow row a page
    before = F.sum("n").over(Window.partitionBy("cik", "y").orderBy("page")) - F.col("n")
    page = page.join(sizes.select("cik", "y", "page", before.cast("int").alias("start")), ["cik", "y", "page"])
    page = page.select(F.concat_ws("", "cik").alias("cik"), "start", F.struct(*[F.col(f"rs.{n}").alias(n) for n in names.values()]).alias("recent"))
    out = readers.recent_filings(page, ["10-k", "10-q", "20-f"], keep=["start"]).withColumn("pos", F.col("pos") + F.col("start"))
    return out.select("cik", "pos", "accession", "form", "filed_at", "period_end", "document", archive_path(F.col("cik"), F.col("accession"), F.col("document")).alias("path"), F.array_join("items", ",").alias("items"))


def filing_index(spark: SparkSession, d: str) -> DataFrame:
    """A short report beside filing_index_all: the first FIRST annual and quarterly reports of each registrant."""
    first = Window.partitionBy("cik").orderBy(F.year("filed_at"), "pos", "accession")
    return filing_index_all(spark, d).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= FIRST).drop("n")


def registrants(spark: SparkSession, d: str) -> DataFrame:
    """Registrant numbers as written and in their normal form."""
    f = table(spark, d, "filings").select("cik").distinct()
    return f.withColumn("normal", normal_cik(F.concat(F.lit(" cik"), F.regexp_replace("cik", "^0+", ""))))


def upserted_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports taken in before a day, with those after it put in by source and external id; rows without a time count as before it."""
    r = table(spark, d, "reports").select("id", "source", "external_id", "category", "status", "ingested_at")
    return sinks.upserted(sinks.upserted(r.limit(0), r.filter(f"coalesce(ingested_at < {SPLIT}, true)"), ["source", "external_id"], "id"), r.filter(f"ingested_at >= {SPLIT}"), ["source", "external_id"], "id")


def replaced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every third filing's chunks replaced by those with content."""
    c = table(spark, d, "chunks").select("id", "document_id", "ordinal", "section")
    new = table(spark, d, "chunks").filter("document_id % 3 = 0 and content is not null and ordinal % 2 = 0").select("id", "document_id", "ordinal", "section")
    return sinks.replaced(c, new, "document_id")


def inserted_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings of even id, and of the others those of a new registrant."""
    f = table(spark, d, "filings").select("id", "cik", "form")
    old, new = f.filter("id % 2 = 0"), f.filter("id % 2 = 1 and cik is not null")
    return sinks.inserted(old, new.groupBy("cik").agg(F.min("id").alias("id"), F.min_by("form", "id").alias("form")), ["cik"])


def vector_cache(spark: SparkSession, d: str) -> DataFrame:
    """One vector per distinct report text."""
    r = table(spark, d, "reports").filter("size(text_embedding) = 384")
    cache = sinks.vector_cache(r.select(F.col("id").alias("doc_id"), F.col("description").alias("text")), r.select(F.col("id").alias("doc_id"), F.col("text_embedding").alias("v")))
    return cache.select("key", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tables as JSON lines."""
    t = table(spark, d, "fin_tables").select("id", "document_id", "ordinal", "caption", "unit")
    return sinks.json_rows(t)


def ingested_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Filings of even ids as they stand, an intake of those divisible by three, whose chunks of odd ordinal come with them: chunks afterwards."""
    f = table(spark, d, "filings").filter("accession is not null").select("id", "cik", "accession", "kind")
    c = table(spark, d, "chunks").join(f.select(F.col("id").alias("document_id"), "accession"), "document_id").select("accession", "id", "ordinal", "section")
    of = lambda rows, some: rows.join(some.select("accession").distinct(), "accession", "left_semi")
    issuers = lambda some: some.select("cik").filter("cik is not null").distinct()
    old, new = f.filter("id % 2 = 0"), f.filter("id % 3 = 0")
    out = sinks.ingested(issuers(new), new, of(c, new).filter("ordinal % 2 = 1"), (issuers(old), old, of(c, old)))
    return out[2]


def corpus_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts as one document per kind, numbered within it."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "kind", F.md5("text").alias("text"), "section", F.lit(None).cast("string").alias("speaker"), F.col("doc_id").alias("pos"))
    return sinks.corpus_documents(docs)[1].select("accession", "external_id", "content", "ordinal")


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Matchers' scores by the contents of both reports."""
    key = lambda c: F.lower(F.trim(c))
    r = table(spark, d, "reports").select(key("point_id").alias("p"), F.col("description").alias("text"))
    m = table(spark, d, "report_matches").select(key("point_a").alias("p"), key("point_b").alias("q"), "score")
    pairs = m.join(r, "p").select(F.col("text").alias("query"), F.col("q").alias("p"), "score").join(r, "p")
    return sinks.pair_score_cache(pairs).withColumn("score", F.round(F.col("score").cast("double"), 6))


def json_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every table with its raw cells as one JSON object."""
    return sinks.table_json(long_cells(table(spark, d, "table_cells"), table(spark, d, "fin_tables")))


def streamed_intake(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed from their files, repeats dropped within the watermark, counted per hour and type."""
    return cut(intake.hourly_counts(spark, f"{d}/events.parquet"))


QUERIES = {
    "open_data": open_data, "image_payloads": image_payloads, "filing_index": filing_index, "filing_index_all": filing_index_all, "registrants": registrants, "upserted_reports": upserted_reports, "replaced_chunks": replaced_chunks,
    "inserted_filings": inserted_filings, "vector_cache": vector_cache, "json_rows": json_rows, "json_tables": json_tables,
    "ingested_chunks": ingested_chunks, "corpus_chunks": corpus_chunks, "pair_scores": pair_scores, "streamed_intake": streamed_intake,
}

_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

SQL = {
    "open_data": """
select coalesce(nullif(raw ->> '$.sr_number', ''), '') as external_id, coalesce(nullif(raw ->> '$.sr_type', ''), 'unknown') as category, nullif(raw ->> '$.status', '') as status,
  try_cast(coalesce(raw ->> '$.location.coordinates[1]', raw ->> '$.latitude') as double) as lat, try_cast(coalesce(raw ->> '$.location.coordinates[0]', raw ->> '$.longitude') as double) as lon
from reports where json_valid(raw) and coalesce(raw ->> '$.sr_number', '') <> ''""",
    "image_payloads": """
select external_id as id, date_trunc('milliseconds', captured_at) as captured_at, 0.0::double as lat, 0.0::double as lon, width, height, compass_angle, storage_path as url, false as pano from images""",
    "filing_index": """
with p as (select *, row_number() over (partition by cik, year(filed_at) order by id) - 1 as pos from filings where cik is not null and filed_at is not null)
select lpad(ltrim(cik, '0'), 10, '0') as cik, pos::int as pos, coalesce(accession, '') as accession, form, filed_at, period_end, coalesce(raw_path, '') as document,
  'edgar/data/' || ltrim(cik, '0') || '/' || replace(coalesce(accession, ''), '-', '') || '/' || coalesce(raw_path, '') as path, coalesce(kind, '') as items from p where upper(form) in ('10-K', '10-Q', '20-F')
qualify row_number() over (partition by cik order by year(filed_at), pos, coalesce(accession, '')) <= 5""",
    "filing_index_all": """
with p as (select *, row_number() over (partition by cik, year(filed_at) order by id) - 1 as pos from filings where cik is not null and filed_at is not null)
select lpad(ltrim(cik, '0'), 10, '0') as cik, pos::int as pos, coalesce(accession, '') as accession, form, filed_at, period_end, coalesce(raw_path, '') as document,
  'edgar/data/' || ltrim(cik, '0') || '/' || replace(coalesce(accession, ''), '-', '') || '/' || coalesce(raw_path, '') as path, coalesce(kind, '') as items from p where upper(form) in ('10-K', '10-Q', '20-F')""",
    "registrants": "select distinct cik, lpad(ltrim(cik, '0'), 10, '0') as normal from filings",
    "upserted_reports": """
with r as (select id, source, external_id, category, status, ingested_at, coalesce(ingested_at >= timestamp '2031-06-01', false)::int as side from reports)
select id, source, external_id, category, status, ingested_at from (select *, row_number() over (partition by source, external_id order by side desc, id desc) as n from r) where n = 1 or source is null or external_id is null""",
    "replaced_chunks": """
with n as (select id, document_id, ordinal, section from chunks where document_id % 3 = 0 and content is not null and ordinal % 2 = 0)
select id, document_id, ordinal, section from chunks where document_id is null or document_id not in (select document_id from n) union all select * from n""",
    "inserted_filings": """
select id, cik, form from filings where id % 2 = 0 union all
select min(id), cik, first(form order by id) from filings where id % 2 = 1 and cik is not null and cik not in (select cik from filings where id % 2 = 0 and cik is not null) group by cik""",
    "vector_cache": f"""
with r as (select id, substr(sha256(trim(regexp_replace(description, '{_SPACE}', ' ', 'g'))), 1, 32) as key, text_embedding as v from reports where len(text_embedding) = 384 and description is not null)
select key, len(v)::int as width, round(list_sum(v::double[]), 6) as total from r qualify row_number() over (partition by key order by id) = 1""",
    "ingested_chunks": """
with f as (select id, accession from filings where accession is not null),
o as (select distinct accession from f where id % 2 = 0), n as (select distinct accession from f where id % 3 = 0),
c as (select accession, c.id, ordinal, section from chunks c join f on f.id = document_id)
select * from c where accession in (select accession from o) and accession not in (select accession from n)
union all select * from c where accession in (select accession from n) and ordinal % 2 = 1""",
    "corpus_chunks": """
select 'fixture-' || coalesce(kind, 'filing') as accession, doc_id as external_id, md5(text) as content, (row_number() over (partition by coalesce(kind, 'filing') order by doc_id) - 1)::int as ordinal from documents where text is not null""",
    "pair_scores": f"""
with s as (select substr(sha256(trim(regexp_replace(a.description, '{_SPACE}', ' ', 'g')) || chr(0) || trim(regexp_replace(b.description, '{_SPACE}', ' ', 'g'))), 1, 32) as key, score::float as score
  from report_matches m join reports a on lower(trim(a.point_id)) = lower(trim(point_a)) join reports b on lower(trim(b.point_id)) = lower(trim(point_b)) where score is not null and a.description is not null and b.description is not null)
select key, round(min(score)::double, 6) as score from s group by key""",
    "json_tables": """
with o as (select c.*, t.document_id, caption, coalesce(col_labels[case when col_idx >= 0 then col_idx + 1 else 1 end], '') as col from table_cells c join fin_tables t on t.id = table_id where not is_header qualify row_number() over (partition by table_id, row_idx, col_idx order by cell_id) = 1),
r as (select table_id, row_idx, first(document_id) as document_id, first(caption) as caption, min(row_label) as label, list(coalesce(raw, '') order by col_idx) as raws, list(col order by col_idx) as cols from o group by 1, 2),
j as (select table_id, first(document_id) as document_id, first(caption) as caption, first(cols order by row_idx) as cols,
  string_agg('{' || case when label is not null then '"label":' || to_json(label) || ',' else '' end || '"values":' || to_json(raws) || '}', ',' order by row_idx) as rows from r group by 1)
select '{"id":' || table_id || case when document_id is not null then ',"document_id":' || document_id else '' end || case when caption is not null then ',"caption":' || to_json(caption) else '' end || ',"columns":' || to_json(cols) || ',"rows":[' || rows || ']}' as value from j""",
    "json_rows": """
select '{' || array_to_string(list_filter(['"id":' || id, '"document_id":' || document_id, '"ordinal":' || ordinal, '"caption":' || to_json(caption), '"unit":' || to_json(unit)], lambda x: x is not null), ',') || '}' as value from fin_tables""",
    "streamed_intake": """
select date_trunc('hour', ts) as hour, event_type, count(*) as events, round(sum(value), 4) as total from (select distinct on (event_id) * from events) group by 1, 2""",
}
