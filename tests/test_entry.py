"""Every registered query with SQL agrees with it on the smallest tables; the others run."""

import math
import os
from datetime import UTC

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import modules

NAMES = sorted(n for m in modules() for n in m.QUERIES)
SQL = {n: s for m in modules() for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v.astimezone(UTC).replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def compare(spark, duck, sf, name, sql):
    df = entry.queries()[name](spark, sf)
    got = sorted(repr([plain(v) for v in r]) for r in df.collect())
    found = duck.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in df.columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_against_sql(spark, duck, sf, name):
    compare(spark, duck, sf, name, SQL[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_runs(spark, sf, name):
    """Queries without SQL are executed, whole."""
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)


def test_chunks_give_their_text_back(spark, sf):
    """The round trip that stands for the SQL of section_chunks: every chunk is its text between its offsets, and windows leave no word out."""
    from lodestrata.operators import sections

    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chunks = entry.queries()["section_chunks"](spark, sf)
    assert sections.misplaced(chunks, texts).count() == 0
    spans = {}
    for r in chunks.select("doc_id", "char_start", "char_end").collect():
        spans.setdefault(r.doc_id, []).append((r.char_start, r.char_end))
    for r in texts.filter("text is not null").collect():
        left, at = [], 0
        for a, b in sorted(spans.get(r.doc_id, [])):
            left.append(r.text[at:a])
            at = max(at, b)
        assert not "".join([*left, r.text[at:]]).strip()


def test_contract(spark, sf):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["cell_id", "unit", "amount_milli"]
