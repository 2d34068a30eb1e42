"""Plans are the ones we want: no Cartesian products, ranks cut before the shuffle, narrow scans, filters at the scan."""

import random
import re

import pytest

import __spark_entry__ as entry
from lodestrata.operators import retrieval


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["bm25_captions", "cell_answers", "duplicate_sweep", "report_queue", "upserted_reports", "rater_kappa_by_kind", "match_calibration", "p1_found", "p7_found", "dense_reports", "html_cells", "ingested_chunks"])
def test_no_cartesian_product(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text
    # nested loops only with a frame of one row: totals of a corpus, of raters, of scores
    assert name in ("bm25_captions", "match_calibration") or "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["duplicate_candidates"])
def test_ranks_are_cut_before_the_shuffle(spark, sf, name):
    assert plan(entry.queries()[name](spark, sf)).count("WindowGroupLimit") >= 2


def test_retrieval_has_one_plan_for_any_number_of_questions(spark, monkeypatch):
    """More blocks of questions or documents mean more tasks, not a larger plan, and the same ranking."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    corpus = spark.createDataFrame([(i, " ".join(rng.choices(words, k=9)), [rng.gauss(0, 1) for _ in range(8)], "ab"[i % 2]) for i in range(300)], "doc_id long, text string, v array<float>, s string")
    asked = corpus.filter("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    for search in (lambda: retrieval.bm25(asked, corpus, 5), lambda: retrieval.dense(asked, corpus, 5), lambda: retrieval.bm25(asked, corpus, 5, scope="s"), lambda: retrieval.dense(asked, corpus, 5, scope="s")):
        seen = []
        for questions, documents in ((1024, 16_384), (7, 50)):
            monkeypatch.setattr(retrieval, "QUESTIONS", questions)
            monkeypatch.setattr(retrieval, "DOCUMENTS", documents)
            df = search()
            seen.append((len(re.findall("FlatMapGroupsInPandas|Exchange", plan(df))), sorted((r.query_id, r.doc_id, r["rank"]) for r in df.collect())))
        assert seen[0] == seen[1] and len(seen[0][1]) == 300


def test_scans_are_narrow(spark, sf):
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()["open_data"](spark, sf))) == ["raw:string"]
    read = ",".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()["report_queue"](spark, sf))))
    assert "text_embedding" not in read and "description" not in read


def test_filters_reach_the_scan(spark, sf):
    text = plan(entry.queries()["question_routes"](spark, sf))
    assert "IsNotNull(content)" in text.split("PushedFilters:")[1].split("ReadSchema")[0]


def test_common_units_broadcast_nothing_by_hint(spark, sf):
    """Tables and filings grow with the cells, so their joins are left to the optimizer's size check."""
    assert "strategy=broadcast" not in plan(entry.queries()["p1_found"](spark, sf))
