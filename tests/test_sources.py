import json

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import sources
from lodestrata.session import cut
from lodestrata.sources import readers, sinks
from lodestrata.streaming import intake


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_golden_set(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '# note\n\n{"id": "x", "inputs": {"q": 1}, "expected": {"v": 2}, "tags": ["hard"]}\n{"id": "y", "inputs": {}, "expected": {}}\n')
    df = readers.golden_set(spark, good)
    assert [(r.id, r.tags) for r in df.orderBy("id").collect()] == [("x", ["hard"]), ("y", [])]
    assert readers.tagged(df, "hard").count() == 1
    with pytest.raises(Exception, match="without id"):
        readers.golden_set(spark, write(tmp_path / "b.jsonl", '{"id": "x"}\n')).collect()
    with pytest.raises(ValueError, match="repeated id x"):
        readers.golden_set(spark, write(tmp_path / "c.jsonl", '{"id": "x", "inputs": {}, "expected": {}}\n' * 2))


def test_recent_filings(spark):
    fields = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "primaryDocDescription", "items"]
    arrays = (["a", "b", "c"], ["10-K", "8-k", "10-Q"], ["2031-02-01", "2031-03-01", "bad"], ["", "2031-01-01"], ["p", "q", "r"], ["d", "e", "f"], ["", "1.01, 9.01", ""])
    df = spark.createDataFrame([("12", arrays), ("13", None)], "cik string, recent struct<" + ",".join(f"{f}:array<string>" for f in fields) + ">")
    got = readers.recent_filings(df).collect()
    assert [(r.cik, r.accession, str(r.filed_at), r.period_end and str(r.period_end), r["items"]) for r in got] == [("0000000012", "a", "2031-02-01", None, []), ("0000000012", "b", "2031-03-01", "2031-01-01", ["1.01", "9.01"])]
    assert [r.accession for r in readers.recent_filings(df, ["8-K"]).collect()] == ["b"]
    assert [r.accession for r in readers.recent_filings(df, limit=1).collect()] == ["a"]


def test_all_filings_of_a_busy_registrant_are_indexed(spark, tmp_path):
    """None is left out beyond the fifth of a year, and positions run on from page to page."""
    n = 2500
    f = spark.range(1, n + 1).select(
        "id", F.lit("0000000012").alias("cik"), F.lit("filing").alias("kind"), F.when(F.col("id") % 2 == 0, "10-K").otherwise("8-K").alias("form"), F.col("id").cast("string").alias("accession"),
        F.lit("t").alias("title"), F.lit("2031-02-01").cast("date").alias("filed_at"), F.lit(None).cast("date").alias("period_end"), F.lit("p").alias("raw_path"),
    )
    f.write.parquet(str(tmp_path / "filings.parquet"))
    got = sorted((r.pos, r.accession) for r in sources.filing_index_all(spark, str(tmp_path)).collect())
    assert got == [(i - 1, str(i)) for i in range(2, n + 1, 2)]


def test_payloads(spark):
    raws = [
        json.dumps({"sr_number": "1", "sr_type": "", "location": {"coordinates": [10.5, 50.0]}, "latitude": "1"}), json.dumps({":id": "2", "latitude": "x", "longitude": "7", "created_date": "2031-01-02T03:04:05Z"}),
        json.dumps({"latitude": "1"}), "not json", None,
    ]
    got = readers.open_data_reports(spark.createDataFrame([(r,) for r in raws], "raw string")).orderBy("external_id").collect()
    assert [(r.external_id, r.category, r.lat, r.lon) for r in got] == [("1", "unknown", 50.0, 10.5), ("2", "unknown", None, 7.0)]
    image = json.dumps({"id": "i", "captured_at": 1000, "geometry": {"coordinates": [3, 4]}, "width": "12", "is_pano": True})
    r = readers.street_images(spark.createDataFrame([(image,)], "raw string")).first()
    assert (r.id, r.lat, r.lon, r.width, r.height, r.pano) == ("i", 4.0, 3.0, 12, None, True)


def test_paged_source_stops_at_a_short_page(spark, tmp_path):
    for offset, n in ((0, 3), (3, 3), (6, 2), (9, 3)):
        write(tmp_path / f"{offset}.jsonl", "".join(f'{{"n": {offset + i}}}\n' for i in range(n)))
    spark.dataSource.register(readers.PagedJson)
    df = spark.read.format("paged_json").options(path=str(tmp_path), page_size=3, max_records=100, span=50).load()
    assert [r.position for r in df.orderBy("position").collect()] == list(range(8))
    assert spark.read.format("paged_json").options(path=str(tmp_path), page_size=3, max_records=4, span=1).load().count() == 4


def test_upsert_insert_replace(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", "z")], "id long, k string, v string")
    new = spark.createDataFrame([(4, "a", "new"), (5, "a", "newest"), (6, None, "w"), (7, "d", "v")], old.schema)
    assert sorted(r.id for r in sinks.upserted(old, new, ["k"], "id").collect()) == [2, 3, 5, 6, 7]
    assert sorted(r.id for r in sinks.inserted(old, new.filter("id <> 5"), ["k"]).collect() if r.k) == [1, 3, 7]
    gone = spark.createDataFrame([("c",)], "k string")
    assert sorted(r.id for r in sinks.replaced(old, new.filter("id = 5"), "k", gone).collect()) == [2, 5]
    assert sinks.upserted(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_partitions_of_other_keys_survive(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc int, v string"), path, "doc")
    sinks.replace_partitions(spark.createDataFrame([(1, "z")], "doc int, v string"), path, "doc")
    assert sorted((r.doc, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


def test_vector_cache_keeps_one_per_text(spark):
    texts = spark.createDataFrame([(2, "a  b"), (1, "a b"), (3, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "doc_id long, v array<double>")
    assert [r.v for r in sinks.vector_cache(texts, vectors).collect()] == [[1.0]]


def test_json_rows_leave_nulls_out(spark):
    assert sinks.json_rows(spark.createDataFrame([(1, None)], "a int, b string")).first().value == '{"a":1}'


def test_stream_drops_repeats_and_replaces(spark, tmp_path):
    from datetime import datetime

    path, out = str(tmp_path / "events.parquet"), str(tmp_path / "out")
    rows = [(1, datetime(2031, 1, 1, 5, 1), "a", 1.0), (1, datetime(2031, 1, 1, 5, 2), "a", 1.0), (2, datetime(2031, 1, 1, 6, 0), "a", 2.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(path)
    assert sorted((r.hour.hour, r.events, r.total) for r in intake.hourly_counts(spark, path).collect()) == [(5, 1, 1.0), (6, 1, 2.0)]
    query = intake.replace_per_key(intake.files(spark, path), out, "event_type", str(tmp_path / "progress"))
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_cut_keeps_rows(spark):
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90


def test_intake_replaces_whole_documents(spark):
    issuers = spark.createDataFrame([("1", "old")], "cik string, name string")
    documents = spark.createDataFrame([("a", "t"), ("b", "t"), (None, "t")], "accession string, title string")
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "accession string, ordinal int")
    came = spark.createDataFrame([("a", "new"), ("c", "new")], "accession string, title string")
    with_it = spark.createDataFrame([("a", 0), ("z", 5)], "accession string, ordinal int")
    i, d, c = sinks.ingested(issuers.limit(0).unionByName(spark.createDataFrame([("1", "new"), ("2", "x")], issuers.schema)), came, with_it, (issuers, documents, chunks))
    assert sorted(map(tuple, i.collect())) == [("1", "new"), ("2", "x")]
    assert {r.accession: r.title for r in d.collect()} == {"a": "new", "b": "t", "c": "new", None: "t"}
    assert sorted(map(tuple, c.collect())) == [("a", 0), ("b", 0)]


def test_an_empty_golden_set_raises(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("# nothing\n\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.golden_set(spark, str(tmp_path / "g.jsonl"))


def test_upserts_keep_rows_without_a_time(spark, sf):
    import __spark_entry__ as entry

    kept = entry.queries()["upserted_reports"](spark, sf)
    raw = spark.read.parquet(f"{sf}/reports.parquet")
    keys = raw.filter("source is not null and external_id is not null").select("source", "external_id").distinct().count()
    assert kept.count() == keys + raw.filter("source is null or external_id is null").count()
