"""Sources: JSON lines with comments, column-wise filing indexes, open-data rows, image rows, and paged offset ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions.text import item_list, normal_cik

GOLDEN = "id string, inputs string, expected string, tags array<string>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank lines and lines that begin with # are passed over. Broken lines give nulls in every field."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(?:#|$)"))
    return lines.select(F.from_json("value", schema).alias("o")).select("o.*")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """id, inputs, expected (JSON text), tags (empty by default); a missing field, a repeated id or a file without rows raises."""
    df = json_lines(spark, path, GOLDEN)
    missing = F.col("id").isNull() | F.col("inputs").isNull() | F.col("expected").isNull()
    df = df.filter(F.when(missing, F.raise_error(F.lit("golden row without id, inputs or expected")).cast("boolean")).otherwise(F.lit(True)))
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    twice = df.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"repeated id {twice.first().id}")
    return df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tagged(examples: DataFrame, tag: str) -> DataFrame:
    return examples.filter(F.array_contains("tags", tag))


def recent_filings(indexes: DataFrame, forms: list[str] | None = None, limit: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """cik, pos, accession, form, filed_at, period_end, document, description, items of column-wise indexes.

    indexes (cik, recent struct of parallel arrays accessionNumber, form, filingDate, reportDate, primaryDocument,
    primaryDocDescription, items). Rows end with the shortest array; forms compare without case, none meaning all; the first `limit`
    of each registrant in the index's order stay. Unreadable dates are null. Columns named in `keep` are carried along.
    """
    keep = keep or []
    arrays = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "primaryDocDescription", "items"]
    n = F.least(*[F.size(f"recent.{a}") for a in arrays])
    rows = indexes.select("cik", *keep, F.posexplode(F.slice(F.arrays_zip(*[F.col(f"recent.{a}").alias(a) for a in arrays]), 1, n)).alias("pos", "f"))
    if forms:
        rows = rows.filter(F.upper("f.form").isin([x.upper() for x in forms]))
    date = lambda c: F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    rows = rows.select(
        normal_cik(F.col("cik").cast("string")).alias("cik"), "pos", F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form"), date(F.col("f.filingDate")).alias("filed_at"),
        date(F.col("f.reportDate")).alias("period_end"), F.col("f.primaryDocument").alias("document"), F.col("f.primaryDocDescription").alias("description"), item_list(F.col("f.items")).alias("items"), *keep,
    )
    if limit is not None:
        from pyspark.sql.window import Window

        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).filter(F.col("_n") <= limit).drop("_n")
    return rows


def _field(payload: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds something."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])


def open_data_reports(rows: DataFrame, payload: str = "raw", source: str = "open-data") -> DataFrame:
    """source, external_id, category, reported_at, status, lat, lon from JSON text; rows without an id are dropped.

    Coordinates come from location.coordinates (lon, lat), else from latitude and longitude; unreadable values are null.
    """
    p = F.col(payload)
    out = rows.select(
        F.lit(source).alias("source"), F.coalesce(_field(p, "$.sr_number", "$[':id']"), F.lit("")).alias("external_id"), F.coalesce(_field(p, "$.sr_type"), F.lit("unknown")).alias("category"),
        F.try_to_timestamp(_field(p, "$.created_date")).alias("reported_at"), _field(p, "$.status").alias("status"),
        _field(p, "$.location.coordinates[1]", "$.latitude").try_cast("double").alias("lat"), _field(p, "$.location.coordinates[0]", "$.longitude").try_cast("double").alias("lon"),
    )
    return out.filter("external_id <> ''")


def street_images(rows: DataFrame, payload: str = "raw") -> DataFrame:
    """id, captured_at, lat, lon, width, height, compass_angle, url, pano from JSON text; coordinates default to 0."""
    p = F.col(payload)
    number = lambda path, kind: F.get_json_object(p, path).try_cast(kind)
    return rows.select(
        F.get_json_object(p, "$.id").alias("id"), F.timestamp_millis(number("$.captured_at", "bigint")).alias("captured_at"), F.coalesce(number("$.geometry.coordinates[1]", "double"), F.lit(0.0)).alias("lat"),
        F.coalesce(number("$.geometry.coordinates[0]", "double"), F.lit(0.0)).alias("lon"), number("$.width", "int").alias("width"), number("$.height", "int").alias("height"),
        number("$.compass_angle", "double").alias("compass_angle"), F.get_json_object(p, "$.thumb_1024_url").alias("url"), F.coalesce(number("$.is_pano", "boolean"), F.lit(False)).alias("pano"),
    )


class PageRange(InputPartition):
    def __init__(self, first: int, pages: int) -> None:
        self.first, self.pages = first, pages


class PagedJson(DataSource):
    """format('paged_json'): rows of a paged service whose answers lie as <path>/<offset>.jsonl, one file a page.

    Options path, page_size (1000), max_records (20000), span (pages in a partition, 4). A partition reads its pages in order and stops
    at an empty, short or absent page. Nothing is fetched over a network here: a fetcher fills the folder, which is the bronze layer.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "position long, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedJsonReader(self.options)


class PagedJsonReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("page_size", 1000))
        self.most, self.span = int(options.get("max_records", 20_000)), int(options.get("span", 4))

    def partitions(self) -> list[InputPartition]:
        pages = -(-self.most // self.size)
        return [PageRange(i, min(self.span, pages - i)) for i in range(0, pages, self.span)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        from pyarrow import fs

        # a path without a scheme is local; others are those of shared storage
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        for page in range(partition.first, partition.first + partition.pages):
            offset = page * self.size
            name = f"{root.rstrip('/')}/{offset}.jsonl"
            if system.get_file_info(name).type == fs.FileType.NotFound:
                return
            n = 0
            with system.open_input_stream(name) as stream:
                for line in stream.read().decode("utf-8").splitlines():  # one page of at most page_size rows
                    if line.strip() and n < self.size and offset + n < self.most:
                        yield offset + n, line.strip()
                        n += 1
            if n < self.size:
                return
