import decimal
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import numbers
from lodestrata.operators import html, metrics, proximity, retrieval, sections, tables, triage, units


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ------------------------------------------------------------------ retrieval


CORPUS = [(1, "plant margin fell"), (2, "margin margin rose"), (3, "the weather"), (4, None), (5, "")]


def brute_bm25(question, corpus, k1=1.5, b=0.75):
    docs = {i: (t or "").lower().split() for i, t in corpus}
    docs = {i: [w for w in t if w != "the"] for i, t in docs.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, t in docs.items():
        s = 0.0
        for w in question.split():
            df, tf = sum(w in x for x in docs.values()), t.count(w)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
        if s:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_against_brute_force(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id long, text string")
    questions = spark.createDataFrame([(7, "margin plant margin"), (8, None), (9, "zebra")], "query_id long, text string")
    got = retrieval.bm25(questions, corpus, 10).orderBy("query_id", "rank").collect()
    want = brute_bm25("margin plant margin", CORPUS)
    assert [(r.query_id, r.doc_id) for r in got] == [(7, i) for i, _ in want]
    assert [r.score for r in got] == pytest.approx([s for _, s in want])


def test_rankings_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    questions = spark.createDataFrame([(7, "margin")], "query_id long, text string")
    assert retrieval.bm25(questions, empty).count() == 0
    vectors = spark.createDataFrame([], "doc_id long, v array<float>")
    assert retrieval.dense(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<float>"), vectors).count() == 0
    assert retrieval.dense(spark.createDataFrame([], "query_id long, v array<float>"), vectors).count() == 0


def test_dense_is_exact_and_skips_bad_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [5.0, 0.0])], "doc_id long, v array<float>")
    got = retrieval.dense(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, v array<float>"), corpus, 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 6, 2]
    assert [r.score for r in got] == pytest.approx([1, 1, math.sqrt(0.5)])


def test_fusion_explanation_and_parity(spark):
    schema = "query_id long, doc_id long, rank int"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], schema)
    fused = retrieval.hybrid(a, b, 3).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [11, 10, 12]
    assert fused[0].score == pytest.approx(1 / 61 + 1 / 62)
    explained = {r.doc_id: r.found_only_by for r in retrieval.explain_hybrid(a, b).collect()}
    assert explained == {10: "bm25", 11: None, 12: "dense"}
    p = retrieval.parity(a, b).first()
    assert (p.exact_order, p.top1, p.overlap, p.displacement, p.one_empty) == (False, False, pytest.approx(1 / 3), 1.0, False)


def test_rerank_moves_and_misses(spark):
    short = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    scores = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9)], "query_id long, doc_id long, score double")
    assert rows(retrieval.rerank(short, scores).select("doc_id", "rank", "moved")) == [(10, 2, -1), (11, 1, 1)]
    with pytest.raises(Exception, match="no score for pair 1, 11"):
        retrieval.rerank(short, scores.filter("doc_id = 10")).collect()


def test_cache_join_raises_on_a_miss(spark):
    cache = spark.createDataFrame([("a", 1), ("a", 1)], "key string, v int")
    assert rows(retrieval.cached(spark.createDataFrame([("a",)], "key string"), cache)) == [("a", 1)]
    with pytest.raises(Exception, match="not in the cache: b"):
        retrieval.cached(spark.createDataFrame([("b",)], "key string"), cache).collect()


def test_anchors(spark):
    corpus = spark.createDataFrame([(1, "net sales rose sharply"), (2, "net sales fell")], "doc_id long, text string")
    asked = spark.createDataFrame([("x", "net sales"), ("y", "fell")], "anchor_id string, anchor string")
    assert rows(retrieval.anchors(asked, corpus)) == [("x", 1), ("x", 2), ("y", 2)]
    with pytest.raises(Exception, match="anchor without"):
        retrieval.anchors(spark.createDataFrame([("z", "zebra")], asked.schema), corpus).collect()


def test_chunks_keep_their_offsets(spark):
    random.seed(4)
    body = " ".join("".join(random.choices("abc", k=random.randint(1, 9))) + random.choice(["", "", ".", "!"]) for _ in range(900))
    texts = spark.createDataFrame([(1, "Intro.\nItem 1. Business\n" + body + "\nItem 2 Risks\nfew words"), (2, None), (3, " \n "), (4, "x" * 3000)], "doc_id long, text string")
    chunks = sections.chunk_texts(texts, 300, 40).cache()
    assert sections.misplaced(chunks, texts).count() == 0
    assert chunks.agg(F.max(F.length("content"))).first()[0] <= 300
    assert {r.section for r in chunks.filter("doc_id = 1").collect()} == {None, "Item 1. Business", "Item 2 Risks"}
    ordinals = [r.ordinal for r in chunks.filter("doc_id = 1").orderBy("ordinal").collect()]
    assert ordinals == list(range(len(ordinals)))
    assert {r.doc_id for r in chunks.collect()} == {1, 4}
    with pytest.raises(ValueError):
        sections.chunk_texts(texts, 100, 100)


# --------------------------------------------------------------------- tables


def store(spark):
    cells = [
        (1, 1, 0, "Net sales", None, None, 0, "1,200", False), (2, 1, 0, "Net sales", None, None, 1, "1,100", False), (3, 1, 1, "Gross margin", "percent", None, 0, "34.2", False),
        (4, 1, 1, "Gross margin", "percent", None, 1, "—", False), (5, 1, 2, None, None, None, 0, None, False), (6, 9, 0, "Lost", None, None, 0, "1", False), (7, 1, 0, "Net sales", None, None, 0, "1,200", False),
    ]
    c = spark.createDataFrame(cells, "cell_id long, table_id long, row_idx int, row_label string, row_unit string, row_scale double, col_idx int, raw string, is_header boolean")
    t = spark.createDataFrame([(1, 5, "Results of the group", 1000.0, "USD", ["2031", "2030"])], "id long, document_id long, caption string, scale_hint double, unit string, col_labels array<string>")
    return tables.long_cells(c, t)


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("What was net sales in 2031?", ("answer", None, 1_200_000.0)),
        ("What was net sales?", ("answer", None, 1_200_000.0)),
        ("What was net sales in 1999?", ("declined", tables.MISSES[0], None)),
        ("Who painted the bridge?", ("declined", tables.MISSES[1], None)),
        ("What share of net revenue came from the largest customer abroad?", ("declined", tables.MISSES[2], None)),
        ("What was gross margin in 2030?", ("declined", tables.MISSES[3], None)),
    ],
)
def test_answers(spark, question, want):
    q = spark.createDataFrame([(1, question)], "query_id long, text string")
    r = tables.answer_questions(q, store(spark)).first()
    assert (r.outcome, r.reason, r.value) == want


def test_long_cells(spark):
    got = {(r.row_idx, r.col_idx): (r.unit, r.scale, r.value) for r in store(spark).collect()}
    assert got == {(0, 0): ("USD", 1000.0, 1.2e6), (0, 1): ("USD", 1000.0, 1.1e6), (1, 0): ("percent", 1.0, 34.2), (1, 1): ("percent", 1.0, None), (2, 0): ("USD", 1000.0, None)}


def test_ragged_fixture_rows_raise(spark):
    df = spark.createDataFrame([("t", ["2031", "2030"], [("a", ["1"])])], "id string, columns array<string>, rows array<struct<label:string,values:array<string>>>")
    with pytest.raises(Exception, match="ragged row in table t"):
        tables.checked_rows(df).collect()


def test_scales_carry_on_across_blocks(spark):
    notes = [(1, i, {2: "(in thousands)", 6000: "Millions of dollars"}.get(i, "text")) for i in range(0, 12000, 2)]
    got = {r.ordinal: r.scale for r in tables.carried_scale(spark.createDataFrame(notes, "document_id long, ordinal int, text string")).collect()}
    assert (got[0], got[2], got[5998], got[6000], got[11998]) == (None, 1e3, 1e3, 1e6, 1e6)


PAGE = """<p>(Dollars in millions)</p><table><tr><td>Result</td><td colspan="2"></td></tr><tr><th></th><th>2031</th><th>2030</th></tr>
<tr><td>Net &amp; gross</td><td>$</td><td>1,234</td><td>(</td><td>56</td><td>)</td></tr><tr><td>Margin</td><td>34.2</td><td>%</td><td>33</td><td>%</td></tr></table>after
<table><tr><td>only</td></tr></table>"""


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<table><tr><td>a<td>b</table>")], "doc_id long, html string")
    got = rows(html.read_tables(pages).select("label", "column", "raw", "row_unit", "scale"))
    assert got == [("Margin", "2030", "33%", "percent", 1e6), ("Margin", "2031", "34.2%", "percent", 1e6), ("Net & gross", "2030", "(56)", None, 1e6), ("Net & gross", "2031", "1,234", None, 1e6)]
    assert {(r.doc_id, r.table_no): r.reason for r in html.table_verdicts(pages).collect()} == {(1, 0): None, (1, 1): "too few rows", (3, 0): "too few rows"}


BANDED = """<table><tr><td>(Millions of dollars)</td><td>North</td><td>South</td><td>Asia</td></tr><tr><td>2031</td></tr><tr><td>Sales</td><td>1</td><td>2</td><td>3</td></tr><tr><td>Less:</td></tr>
<tr><td>Costs</td><td>4</td><td>5</td><td>6</td></tr><tr><td>2030</td></tr><tr><td>Sales</td><td>7</td><td>8</td><td>9</td></tr><tr><td>Costs</td><td>7</td><td>8</td></tr></table>"""
STACKED = "<table><tr><td></td><td>Machines</td><td>Services</td></tr><tr><td></td><td>2031</td><td>2030</td></tr><tr><td>Sales</td><td>1</td><td>2</td></tr></table>"


def test_banded_and_stacked_tables(spark):
    pages = spark.createDataFrame([(1, BANDED), (2, STACKED), (3, BANDED.replace("2030", "2031")), (4, BANDED.replace("Costs</td><td>4", "Sales</td><td>4"))], "doc_id long, html string")
    got = rows(html.read_tables(pages).select("doc_id", "label", "column", "raw", "col_idx", "scale"))
    assert got == sorted((1, f"Sales -- {name}", year, raw, i, 1e6) for i, year, raws in ((0, "2031", "123"), (1, "2030", "789")) for name, raw in zip(("North", "South", "Asia"), raws, strict=True))
    assert {r.doc_id: r.reason for r in html.table_verdicts(pages).collect()} == {1: None, 2: "stacked header", 3: "no year header", 4: "no year header"}


def table_of(*trs):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in tr) + "</tr>" for tr in trs) + "</table>"


YEARS = ("", "2031", "2030")


def test_titles_captions_and_units_of_tables(spark):
    page = "<div><h2>Note 4</h2><p>Segments</p>" + table_of(("Sales by segment",), ("(Millions of dollars)",), YEARS, ("Rail", "1", "(2)"), ("Sea", "—", "n/a")) + "tail</div><div>" + table_of(YEARS, ("Rail", "3", "4"), ("Sea", "5", "6")) + "</div>"
    got = {(r.table_no, r.label, r.column): r for r in html.read_tables(spark.createDataFrame([("f", page)], "doc_id string, html string")).collect()}
    first, second = got[0, "Rail", "2030"], got[1, "Rail", "2030"]
    assert (first.caption, first.unit, first.scale, first.inherited, first.value, first.table_id) == ("Sales by segment | (Millions of dollars) | Note 4 | Segments", "USD", 1e6, False, -2e6, "f-t0")
    assert (second.caption, second.unit, second.scale, second.inherited, second.value) == (" [scale inherited from section]", "unknown", 1e6, True, 4e6)
    assert got[0, "Sea", "2031"].value is None and got[0, "Sea", "2030"].value is None


def test_row_scales_carry_to_rows_of_their_kind(spark):
    """A scale stated on one row holds for rows of the same kind that take none from the table, and for no others."""
    page = table_of(("(in thousands)",), YEARS, ("Number of shares, basic", "10", "11"), ("Shares outstanding (in millions)", "12", "13"), ("Sales (in billions)", "2", "3"), ("Costs", "4", "5"), ("Margin", "6%", "7%"))
    got = {(r.label, r.column): (r.row_unit, r.row_scale, r.value) for r in html.read_tables(spark.createDataFrame([(1, page)], "doc_id long, html string")).collect()}
    assert got["Number of shares, basic", "2031"] == ("count", 1e6, 10e6) and got["Shares outstanding (in millions)", "2030"] == ("count", 1e6, 13e6)
    assert got["Sales (in billions)", "2031"] == (None, 1e9, 2e9) and got["Costs", "2030"] == (None, None, 5e3) and got["Margin", "2031"] == ("percent", None, 6.0)


def test_scale_of_the_table_beats_its_caption_and_the_section(spark):
    note = "<p>(Dollars in millions)</p>"
    page = note + "<div>" + table_of(("(in thousands)",), YEARS, ("A", "1", "2"), ("B", "3", "4")) + "</div>" + note + table_of(YEARS, ("A", "1", "2"), ("B", "3", "4")) + "<div>" + table_of(YEARS, ("A", "1", "2"), ("B (in billions)", "3", "4")) + "</div>"
    got = {r.table_no: (r.scale, r.inherited) for r in html.read_tables(spark.createDataFrame([(1, page)], "doc_id long, html string")).collect()}
    assert got == {0: (1e3, False), 1: (1e6, False), 2: (1e9, False)}


def test_spans_rows_and_previews(spark):
    wide = "<table><tr><td colspan='999999999'>T</td></tr><tr><td rowspan='3'>a</td><td colspan='x'>b</td></tr><tr><td>c</td></tr></table>"
    blank = table_of(YEARS, ("", "", ""), ("Rail", "1", "2"), ("Sea", "3", "4"))
    pages = spark.createDataFrame([(1, wide), (2, blank), (3, table_of(("x",), ("y",)) + "<p>no table</p>")], "doc_id long, html string")
    assert [(r.row_no, r.col_no, r.text) for r in html.page_cells(pages).filter("doc_id = 1 and row_no >= 0").orderBy("row_no", "col_no").collect()] == [(0, 0, "T"), (1, 0, "a"), (1, 1, "b"), (2, 1, "c")]
    said = {r.doc_id: (r.reason, r.preview) for r in html.table_verdicts(pages).collect()}
    assert said == {1: ("no year header", "T a b c"), 2: (None, "2031 2030 Rail 1 2 Sea 3 4"), 3: ("too few rows", "x y")}
    assert {r.doc_id: (r.tables, r.rate) for r in html.extraction_rates(html.table_verdicts(pages)).collect()} == {1: (1, 0.0), 2: (1, 1.0), 3: (1, 0.0)}


def test_narrative_and_bytes(spark):
    page = "<html><head><style>p {}</style></head><body><p>Plant — grew</p>" + table_of(("a", "1")) + "lost tail<script>x()</script><div>by  <b>four</b></div></body></html>"
    df = spark.createDataFrame([(1, bytearray(b"<?xml encoding='ASCII'?>" + page.encode())), (2, None), (3, bytearray(b""))], "doc_id long, html binary")
    assert rows(html.narrative_texts(df)) == [(1, "Plant — grew\nby\nfour"), (3, "")]


# --------------------------------------------------------------------- triage


REPORT = "id long, source string, external_id string, category string, description string, reported_at timestamp, segment_id long, geom string, text_embedding array<float>"


def reports(spark, data):
    from datetime import datetime

    full = [(i, "s", f"e{i}", c, t, datetime(2031, m, d) if m else None, g, p, v) for i, c, t, (m, d), g, p, v in data]
    return spark.createDataFrame(full, REPORT)


def test_duplicates_and_clusters(spark):
    here = "POINT (10.0 50.0)"
    near = "POINT (10.0001 50.0)"
    r = reports(spark, [
        (1, "hole", "big hole by bakery", (1, 1), 7, here, None), (2, "hole", "big hole by bakery", (1, 5), 7, near, None), (3, "lamp", "big hole by bakery", (1, 5), 7, here, None),
        (4, "hole", "big hole by bakery", (9, 1), 7, here, None), (5, None, "big hole bakery", (0, 0), 7, here, None), (6, "hole", None, (1, 1), None, None, None),
        (7, "hole", "big hole by bakery", (1, 2), 7, "POINT (10.01 50.0)", None),
    ])
    pairs = {(x.a_id, x.b_id) for x in triage.duplicates(r).collect()}
    assert pairs == {(1, 2), (1, 5), (2, 5), (3, 5), (4, 5)}
    groups = {x.report_id: x.cluster_id for x in triage.clusters(r).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}
    near_one = triage.duplicate_candidates(r, limit=1).filter("report_id = 1").first()
    assert (near_one.other_id, near_one.same_segment, near_one.rank) == (2, True, 1)
    assert triage.clusters(r.limit(0)).count() == 0


def test_rule_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        triage.DedupeRule(w_text=0.5)


def test_least_labels_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("b"), (F.col("id") + 1).alias("a"))
    got = triage.least_labels(edges)
    assert got.count() == 201 and got.filter("label <> 0").isEmpty()


def test_queue_order_and_bands(spark):
    r = reports(spark, [(1, "a", None, (5, 1), 3, None, None), (2, "a", None, (0, 0), None, None, None), (3, "a", None, (4, 1), 3, None, None), (4, "a", None, (2, 1), 3, None, None)])
    groups = spark.createDataFrame([(1, 1), (3, 1), (2, 2), (4, 4)], "report_id long, cluster_id long")
    segments = spark.createDataFrame([(3, "Long St")], "id long, name string")
    got = [(x.cluster_id, x.street, x.reports) for x in triage.report_queue(groups, r, segments).collect()]
    assert got == [(1, "Long St", 2), (4, "Long St", 1), (2, None, 1)]
    banded = triage.banded(spark.createDataFrame([(0.0,), (20.0,), (99.0,), (-1.0,), (None,)], "x double"), "x", [(0, "low"), (20, "mid"), (45, "high")], "b")
    assert [x.b for x in banded.collect()] == ["low", "mid", "high", None, None]


def test_one_per_source(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, None, "x")], "id long, source string, external_id string")
    assert [x.id for x in triage.one_per_source(df).orderBy("id").collect()] == [1, 3, 4]


# ------------------------------------------------------------------ proximity


def brute_metres(a, b):
    (lo1, la1), (lo2, la2) = a, b
    x = math.sin(math.radians(la2 - la1) / 2) ** 2 + math.cos(math.radians(la1)) * math.cos(math.radians(la2)) * math.sin(math.radians(lo2 - lo1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(x)))


@pytest.mark.parametrize("sizes", [{}, {"leaf": 50, "block": 7}])
def test_radius_join_against_brute_force(spark, sizes):
    random.seed(9)
    spots = [(random.uniform(-1, 1) * 1e-3 + random.choice([0.0, 180.0, -179.9995, 45.0]), random.uniform(-1, 1) * 1e-3 + random.choice([0.0, 60.0, 89.9995])) for _ in range(160)]
    spots = [(lo - 360 if lo > 180 else lo + 360 if lo < -180 else lo, min(90.0, la)) for lo, la in spots] + [(45.0, 60.0)] * 4
    left = spark.createDataFrame([(i, la, lo) for i, (lo, la) in enumerate(spots)] + [(999, None, 1.0)], "lid long, lat double, lon double")
    got = {(r.lid, r.rid) for r in proximity.pairs_within(left, left.withColumnRenamed("lid", "rid"), 60.0, **sizes).collect()}
    want = {(i, j) for i, a in enumerate(spots) for j, b in enumerate(spots) if brute_metres(a, b) <= 60}
    assert got == want and len(want) > 300


@pytest.mark.parametrize(
    ("geom", "want"),
    [
        ("POINT(1 2)", (1.0, 2.0)), (" srid=4326; point z (1.5  -2 9) ", (1.5, -2.0)), ('{"type": "Point", "coordinates": [3, 4.5]}', (3.0, 4.5)), ("POINT(0 0)", None), ("POINT EMPTY", None),
        ("POINT(181 2)", None), ("POINT(1 91)", None), ("LINESTRING(1 2, 3 4)", None), ("", None), (None, None), ("POINT(1e1 -2.5E0)", (10.0, -2.5)),
    ],
)
def test_points(spark, geom, want):
    lon, lat = proximity.point_of(F.col("g"))
    r = spark.createDataFrame([(geom,)], "g string").select(lon.alias("x"), lat.alias("y")).first()
    assert (r.x, r.y) == (want or (None, None))


def test_nearest_line_ties_and_date_line(spark):
    lines = spark.createDataFrame([(5, "LINESTRING(179.9999 10, -179.9999 10)"), (4, "LINESTRING(10 50.0001, 10.01 50.0001)"), (3, "LINESTRING(10 50.0001, 10.01 50.0001)"), (2, "LINESTRING(1 1)"), (1, None)], "id long, geom string")
    points = spark.createDataFrame([(1, 50.0, 10.005), (2, 10.0001, -180.0), (3, 0.5, 0.5), (4, None, None)], "lid long, lat double, lon double")
    got = {r.lid: (r.sid, r.metres) for r in proximity.nearest_line(points, lines, 50.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 3, 2: 5}
    assert got[1][1] == pytest.approx(0.0001 * math.pi * 6_371_000 / 180, abs=1e-4)


def test_proximity_of_nothing(spark):
    r = spark.createDataFrame([], "id long, geom string")
    assert proximity.near_reports(r, r, r).count() == 0


# ---------------------------------------------------------------------- units


@pytest.mark.parametrize(
    ("raw", "figure"),
    [("1,234.5", "1234.5"), ("(12)", "-12"), ("−3.5", "-3.5"), ("$ 7", "7"), ("12(1)", "12"), ("12*", "12"), ("1.5 million", "1.5"), ("—", None), ("n/a", None), ("see note 3", None), ("", None), (None, None), ("48.2%", "48.2")],
)
def test_parse_figures(spark, raw, figure):
    r = units.parse_figures(spark.createDataFrame([(raw,)], "raw string")).first()
    got = None if r.digits is None else (-1 if r.negative else 1) * int(r.digits) / 10**r.places
    assert got == (None if figure is None else float(figure))


CELL = "cell_id long, cik string, table_id long, row_idx int, row_label string, row_unit string, row_scale double, col_idx int, raw string, is_header boolean, unit string"


def test_levels_of_statements(spark):
    cells = spark.createDataFrame([
        (1, "c", 1, 0, "Sales", None, None, 0, "1.5 million", False, "clash"), (2, "c", 1, 0, "Sales", None, 1e3, 0, "2", False, ""), (3, "c", 1, 0, "Sales", None, None, 0, "3", False, ""),
        (4, "c", 1, 0, "Rate", "percent", None, 0, "4", False, ""), (5, "c", 2, 0, "Sales", None, None, 0, "5", False, ""), (6, "c", 9, 0, "Sales", None, None, 0, "6", False, ""),
        (7, "c", 1, 0, "Plant", "TJ", 1.0, 0, "1", False, ""), (8, "c", 1, 0, "h", None, None, 0, "2031", True, ""), (9, "c", 1, 0, "Sales", None, None, 0, None, False, ""), (10, "c", 1, 0, "Yield", "bps", None, 0, "25", False, ""),
    ], CELL)
    t = spark.createDataFrame([(1, 1, "Results", 1e6, "USD"), (2, 1, None, None, None)], "id long, document_id long, caption string, scale_hint double, unit string")
    f = spark.createDataFrame([(1, 1e9, "x")], "id long, scale_hint double, unit string")
    got = {r.cell_id: (r.unit, r.amount_milli) for r in units.common_units(cells, t, f).collect()}
    assert got == {
        1: ("USD", 1_500_000_000), 2: ("USD", 2_000_000), 3: ("USD", 3_000_000_000), 4: ("percent", 4000), 5: ("USD", 5_000_000_000_000), 6: ("USD", 6000), 7: ("kWh", 277_777_778), 10: ("percent", 250)
    }
    assert units.common_units(cells.limit(0), t, f).count() == 0


def rounded(value):
    return int(value.to_integral_value(decimal.ROUND_HALF_UP)) if value >= 0 else -int((-value).to_integral_value(decimal.ROUND_HALF_UP))


def test_amounts_are_exact_for_every_unit_at_every_scale(spark):
    """No rounding before scaling, no overflow: amounts equal unlimited decimals, or are null beyond a bigint."""
    rows, want = [], {}
    with decimal.localcontext(decimal.Context(prec=200)):
        for raw, number in (("1.2", "1.2"), ("1.23456", "1.23456"), ("0.00004", "0.00004"), ("(999,999,999,999,999.5)", "-999999999999999.5"), ("12345678901234567890123.4567", "12345678901234567890123.4567"), ("0", "0"), ("0.0005", "0.0005")):
            for word, (unit, milli) in units.UNITS.items():
                for scale in (1.0, 1e3, 1e6, 1e9, 1e12, 2.5, 0.01):
                    top, _, bottom = milli.partition("/")
                    value = decimal.Decimal(number) * decimal.Decimal(str(scale)) * decimal.Decimal(top) / decimal.Decimal(bottom or 1)
                    rows.append((len(rows), "c", 1, 0, "x", word, scale, 0, raw, False, ""))
                    want[len(rows) - 1] = (unit, rounded(value) if abs(value) < 9.2e18 else None)
    t = spark.createDataFrame([], "id long, document_id long, caption string, scale_hint double, unit string")
    f = spark.createDataFrame([], "id long, scale_hint double")
    got = {r.cell_id: (r.unit, r.amount_milli) for r in units.common_units(spark.createDataFrame(rows, CELL), t, f).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("raw", "unit", "milli"),
    [("1.2 trillion", "USD", 1_200_000_000_000_000), ("1 billion tonnes", "kg", 10**15), ("2 million GWh", "kWh", 2 * 10**15), ("1.23456 billion", "USD", 1_234_560_000_000), ("0.00004", "USD", 0), ("90 trillion short tons", "kg", None)],
)
def test_large_and_small_figures(spark, raw, unit, milli):
    t = spark.createDataFrame([(1, 1, "Results", 1.0, "USD")], "id long, document_id long, caption string, scale_hint double, unit string")
    f = spark.createDataFrame([(1, 1.0)], "id long, scale_hint double")
    r = units.common_units(spark.createDataFrame([(1, "c", 1, 0, "Sales", None, None, 0, raw, False, "")], CELL), t, f).first()
    assert (r.unit, r.amount_milli) == (unit, milli)


FIGURES = "cell_id long, cik string, table_id long, row_label string, row_unit string, row_scale double, raw string, is_header boolean, col_idx int"
TABLES = "id long, document_id long, caption string, scale_hint double, unit string"


def test_unstated_scales_are_found_or_flagged(spark):
    """With no scale stated the size of the issuer's other figures decides; where it can't, the figure stays as printed and is flagged."""
    cells = [(1, "a", 1, "Sales", "5,000,000"), (2, "a", 2, "Sales", "5.1"), (3, "a", 3, "Sales", "4,900,000"), (4, "a", 4, "Rent", "70"), (5, "a", 9, "Sales", "5,050,000"), (6, "a", 1, "Margin", "7 %"), (7, "b", 5, "Odd label", "0")]
    df = spark.createDataFrame([(i, c, t, la, None, None, raw, False, 0) for i, c, t, la, raw in cells], FIGURES)
    t = spark.createDataFrame([(1, 1, "Results", 1.0, "USD"), *[(n, 2, "Results", None, "USD") for n in (2, 3, 4, 5)]], TABLES)
    f = spark.createDataFrame([(1, 1e3), (2, None)], "id long, scale_hint double")
    got = {r.cell_id: (r.amount_milli, r.unique, r.solved) for r in units.common_units(df, t, f).collect()}
    assert got == {
        1: (5_000_000_000, True, False), 2: (5_100_000_000, True, True), 3: (4_900_000_000, True, True), 4: (70_000, False, True), 5: (5_050_000_000, True, True), 6: (7000, True, False), 7: (0, False, True)
    }


def test_a_column_s_identities_settle_contradictory_statements(spark):
    """The table says thousands and millions. Net earnings = earnings per share x shares, and sales = costs + profit, tell which; without them neither."""
    rows = [
        (1, "a", 1, "Net earnings", None, None, "20", 0), (2, "a", 1, "Diluted earnings per share", "per_share", None, "2.00", 0), (3, "a", 1, "Diluted weighted shares", "shares", 1e6, "10", 0), (4, "a", 1, "Rent", None, None, "3", 0),
        (5, "b", 2, "Net sales", None, None, "50", 1), (6, "b", 2, "Cost of goods sold", None, None, "30 thousand", 1), (7, "b", 2, "Gross profit", None, None, "20 thousand", 1), (8, "c", 3, "Net earnings", None, None, "20", 0),
    ]
    df = spark.createDataFrame([(i, c, t, la, u, s, raw, False, k) for i, c, t, la, u, s, raw, k in rows], FIGURES)
    t = spark.createDataFrame([(n, 1, "Results (in millions)", 1e3, "USD") for n in (1, 2, 3)], TABLES)
    f = spark.createDataFrame([(1, 1.0)], "id long, scale_hint double")
    got = {r.cell_id: (r.amount_milli, r.unique, r.solved) for r in units.common_units(df, t, f).collect()}
    assert got[1] == (20_000_000_000, True, True) and got[4] == (3_000_000_000, True, True)  # one choice for the table
    assert got[5] == (50_000_000, True, True) and got[6][2] is False
    assert got[8][1:] == (False, True)  # nothing to hold it against


def test_the_dimension_that_a_label_has_elsewhere(spark):
    rows = [(1, "a", 1, "Gas fired", "MWh", 1.0, "5,000"), (2, "a", 1, "Gas fired", "GWh", 1.0, "5.5"), (3, "a", 2, "Gas fired", None, 1.0, "5.2"), (4, "a", 2, "Yard", None, 1.0, "9"), (5, "b", 3, "Gas fired", None, 1.0, "0")]
    df = spark.createDataFrame([(i, c, t, la, u, s, raw, False, 0) for i, c, t, la, u, s, raw in rows], FIGURES)
    t = spark.createDataFrame([(n, 1, None, None, None) for n in (1, 2, 3)], TABLES)
    f = spark.createDataFrame([(1, None)], "id long, scale_hint double")
    got = {r.cell_id: (r.unit, r.amount_milli, r.unique) for r in units.common_units(df, t, f).collect()}
    assert got[3] == ("kWh", 5_200_000_000, True) and got[4] == ("USD", 9000, False) and got[5][0] == "kWh" and not got[5][2]


def test_units_of_odd_input(spark):
    """Nulls anywhere, repeated rows, long texts and clashing columns give defined results."""
    rows = [(None, None, None, None, None, None, "5", False, None), (1, "a", None, "x", None, float("nan"), "6", False, 0), (1, "a", None, "x", None, float("nan"), "6", False, 0), (2, "a", 1, "x" * 50_000, None, -1.0, "7" * 3000, False, 0), (3, "a", 1, "", "", 0.0, "x\x015\x01", False, 0), (4, "a", 1, "x", "furlongs", None, "8", None, 0)]
    df = spark.createDataFrame(rows, FIGURES).selectExpr("*", "1 as unit", "2 as word", "3 as scale")
    t = spark.createDataFrame([(1, None, None, float("inf"), None), (None, None, None, 1e3, "kWh")], TABLES)
    f = spark.createDataFrame([(None, 1e6)], "id long, scale_hint double")
    got = sorted((r.cell_id or 0, r.amount_milli) for r in units.common_units(df, t, f).collect())
    assert got[:3] == [(0, 5000), (1, 6000), (1, 6000)] and got[3:] == [(2, None)]


def test_identities_pick_the_units(spark):
    """mass = density x volume settles which units were meant; with one observation free, two choices fit alike."""
    obs = [("a", i, q, math.log(v)) for i, (m, d, v3) in enumerate([(2000.0, 1.0, 2.0), (900.0, 0.9, 1.0)]) for q, v in (("mass", m), ("density", d), ("volume", v3))]
    values = spark.createDataFrame(obs, "g string, obs int, quantity string, log_value double")
    options = [("a", "mass", "kg", 0.0), ("a", "mass", "t", math.log(1000)), ("a", "density", "kg/m3", 0.0), ("a", "density", "g/cm3", math.log(1000)), ("a", "volume", "m3", 0.0)]
    candidates = spark.createDataFrame(options, "g string, quantity string, option string, log_factor double")
    best = units.solve_combinations(values, candidates, ["g"], [{"mass": 1, "density": -1, "volume": -1}]).first()
    assert best.choice == {"mass": "kg", "density": "g/cm3", "volume": "m3"} and best.unique
    both = candidates.unionByName(spark.createDataFrame([("a", "volume", "dam3", math.log(1000))], candidates.schema))
    assert not units.solve_combinations(values, both, ["g"], [{"mass": 1, "density": -1, "volume": -1}]).first().unique


# -------------------------------------------------------------------- metrics


def test_ranking_quality(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 20)], "query_id long, doc_id long")
    ranking = spark.createDataFrame([(1, 99, 1), (1, 10, 2), (1, 11, 12)], "query_id long, doc_id long, rank int")
    got = {r.query_id: r for r in metrics.ranking_quality(gold, ranking, 10).collect()}
    assert (got[1].recall, got[1].precision, got[1].rr) == (0.5, 0.1, 0.5)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[2].recall, got[2].rr, got[2].ndcg) == (0.0, 0.0, 0.0)


def test_binary_sweep_kappa_calibration(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.4), (False, 0.8), (None, 0.1)], "t boolean, s double")
    r = metrics.binary_scores(df.withColumn("p", F.col("s") > 0.5), "t", "p").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1, r.support) == (1, 1, 1, 0.5, 0.5, 0.5, 2)
    sweep = {x.threshold: (x.precision, x.recall) for x in metrics.threshold_sweep(df, "t", "s", [0.3, 0.95]).collect()}
    assert sweep[0.3] == (pytest.approx(2 / 3), 1.0) and sweep[0.95] == (0.0, 0.0)
    raters = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y"), (None, "y")], "a string, b string")
    k = metrics.kappa(raters, "a", "b").first()
    assert (k.n, k.observed, k.kappa) == (4, 0.75, pytest.approx((0.75 - 0.5) / 0.5))
    assert metrics.kappa(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first().kappa == 1.0
    cal = metrics.calibration(spark.createDataFrame([(0.0, False), (0.1, True), (0.95, True), (1.5, True)], "c double, ok boolean"), "c", "ok")
    got = {x["bin"]: (x.n, x.gap) for x in cal.collect()}
    assert got == {0: (2, pytest.approx(0.5 * 0.45)), 9: (1, pytest.approx(0.25 * 0.05))}


def test_average_precision(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    truth = spark.createDataFrame([("i", "a", 0, (0.0, 0.0, 10.0, 10.0)), ("i", "a", 1, (20.0, 0.0, 30.0, 10.0)), ("j", "b", 0, (0.0, 0.0, 1.0, 1.0))], f"image_id string, label string, pos int, box {box}")
    said = spark.createDataFrame([("i", "a", 0.9, 0, (0.0, 0.0, 10.0, 10.0)), ("i", "a", 0.8, 1, (0.0, 0.0, 10.0, 10.0)), ("i", "a", 0.7, 2, (20.0, 0.0, 30.0, 10.0)), ("k", "c", 0.7, 2, (0.0, 0.0, 1.0, 1.0))], f"image_id string, label string, score double, pos int, box {box}")
    got = {x.label: x.ap for x in metrics.average_precision(said, truth, [0.5]).collect()}
    assert got == {"a": pytest.approx(0.5 + 0.5 * 2 / 3), "b": 0.0}


def test_gates(spark):
    m = spark.createDataFrame([("floor", 0.5), ("ceil", 2.0), ("back", 0.8), ("fine", 0.9), ("new", 0.9)], "metric string, value double")
    base = spark.createDataFrame([("back", 0.9), ("fine", 0.9)], "metric string, prior double")
    gates = spark.createDataFrame([("gone", None, None, None, True), ("floor", 0.6, None, None, True), ("ceil", None, 1.0, None, True), ("back", None, None, 0.05, True), ("fine", 0.1, 1.0, 0.05, True), ("new", None, None, 0.1, None)], "metric string, min_value double, max_value double, max_regression double, higher_is_better boolean")
    got = {r.metric: (r.verdict, r.passed) for r in metrics.gate_results(m, base, gates).collect()}
    assert got == {"gone": ("missing", False), "floor": ("below floor", False), "ceil": ("above ceiling", False), "back": ("regressed", False), "fine": ("ok", True), "new": ("no baseline yet", True)}


def test_metric_reports(spark):
    m = lambda df: {r.metric: round(r.value, 6) for r in df.collect()}
    answers = spark.createDataFrame([("5", "5", 1.0, False, None, "x"), ("7", "6", 1.0, False, None, "x"), (None, "6", 1.0, False, None, "y"), (None, None, None, True, "not-extracted", "y"), ("1", None, None, True, None, "y")], "predicted string, gold string, scale_hint double, not_disclosed boolean, reason string, tag string")
    got = m(metrics.numeric_report(answers, {"x": F.col("tag") == "x", "z": F.col("tag") == "z"}))
    assert got == {"exact_match": round(1 / 3, 6), "answerable_n": 3, "coverage_gap": 0.2, "exact_match.x": 0.5, "refusal_precision": 0.5, "refusal_recall": 0.5, "refusal_f1": 0.5, "refusal_support": 2}
    routes = spark.createDataFrame([("numeric", ["numeric", "cross-modal"]), ("narrative", ["narrative"]), ("numeric", []), ("cross_modal", ["cross-modal", "narrative"])], "route string, tags array<string>").withColumn("expected", metrics.expected_route(F.col("tags")))
    assert m(metrics.routing_report(routes)) == {"accuracy": 0.5, "kappa": 0.333333, "recall.cross_modal": 0.5, "recall.narrative": 0.5}
    assert m(metrics.heldout_report(routes)) == {"accuracy": 0.5, "leaked_to_narrative": 0.25}
    pairs = spark.createDataFrame([(True, True, True), (False, True, True), (None, False, False), (True, None, False)], "truth boolean, said boolean, hard boolean")
    assert m(metrics.dedupe_report(pairs, hard=F.col("hard"))) == {"pair_precision": 0.5, "pair_recall": 0.5, "pair_f1": 0.5, "pair_support": 2, "accuracy": 0.5, "false_merge_rate": 0.25, "accuracy.hard": 0.5}
    gold = spark.createDataFrame([(1, 10), (2, 20)], "query_id long, doc_id long")
    a = spark.createDataFrame([(1, 10, 1), (2, 20, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 10, 1), (3, 30, 1)], "query_id long, doc_id long, rank int")
    assert {r.query_id: round(r.delta, 4) for r in metrics.stage_diagnosis(gold, {"first": b, "last": a}).collect()} == {1: 0.0, 2: round(1 / math.log2(3), 4)}
    assert m(metrics.scored_comparison(gold, {"b": b})) == {"b.ndcg@10": 0.5, "b.recall@10": 0.5}
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id long")
    r = metrics.arm_report({"x": retrieval.parity(a, b, questions=asked)}).first()
    assert (r.queries, r.exact_order, r.top1_agreement, r.overlap, r.asymmetric_empty) == (4, 0.5, 0.25, 0.5, 2)


def test_mean_average_precision_in_ranges_equals_one_range(spark, monkeypatch):
    rng = random.Random(8)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    at = lambda x: (x, 0.0, x + 10.0, 10.0)
    truth = spark.createDataFrame([(i, "ab"[i % 2], k, at(20.0 * k)) for i in range(20) for k in range(3)], f"image_id long, label string, pos int, box {box}")
    said = spark.createDataFrame([(i, "ab"[i % 2], rng.choice([0.1, 0.5, rng.random()]), k, at(20.0 * k + rng.uniform(0, 6))) for i in range(22) for k in range(4)], f"image_id long, label string, score double, pos int, box {box}")
    many = {(r.label, r.threshold): round(r.ap, 9) for r in metrics.average_precision(said, truth, [0.5, 0.75]).collect()}
    monkeypatch.setattr(metrics, "RANGES", 0)
    assert many == {(r.label, r.threshold): round(r.ap, 9) for r in metrics.average_precision(said, truth, [0.5, 0.75]).collect()} and all(0 < x < 1 for x in many.values())
    report = {r.metric: r.value for r in metrics.detection_report(said, truth).collect()}
    assert report["n_predictions"] == 88 and 0 < report["map_50_95"] < report["map_50"] == pytest.approx((report["ap_50.a"] + report["ap_50.b"]) / 2) and 0 <= report["ece"] <= 1
    empty = {r.metric: r.value for r in metrics.detection_report(said, truth.limit(0)).collect()}
    assert empty["map_50"] == empty["map_50_95"] == 0.0


def test_detections_of_many_images(spark):
    """A prediction is a row of its own even where one image's rows share score and position; the work doesn't grow by a frame per image."""
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    square = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(1.0).alias("y2"))
    truth = spark.range(40_000).select(F.col("id").alias("image_id"), F.lit("a").alias("label"), F.lit(0).alias("pos"), square.alias("box"))
    said = truth.select("image_id", "label", (F.col("image_id") / 40_000).alias("score"), "pos", "box")
    began = time.perf_counter()
    got = metrics.average_precision(said.unionByName(said.filter("image_id < 20000")), truth, list(metrics.IOUS)).collect()
    assert time.perf_counter() - began < 60 and len(got) == 10
    later = sum((20_000 + k) / (20_000 + 2 * k - 1) for k in range(1, 20_001))
    assert all(r.ap == pytest.approx((20_000 + later) / 40_000, abs=1e-4) for r in got)
    odd = spark.createDataFrame([(1, "a", 0.9, 0, (0.0, 0.0, 1.0, 1.0)), (1, "a", float("nan"), 1, (5.0, 0.0, 6.0, 1.0)), (1, "a", None, 2, (0.0, 0.0, 1.0, 1.0))], f"image_id long, label string, score double, pos int, box {box}")
    assert [r.ap for r in metrics.average_precision(odd, truth.filter("image_id = 1"), [0.5]).collect()] == [0.5]


def test_contradictions_and_covering_labels(spark):
    rows_ = spark.createDataFrame([(1, 5.0, "It was 5.01 and 7."), (2, 5.0, "It was 6, 7, 8 and 9."), (3, None, "6"), (4, 5.0, None), (5, 5.0, "no figure")], "id long, value double, text string")
    got = {r.id: r.contradiction for r in tables.contradictions(rows_).collect()}
    assert got == {1: None, 2: "table cell resolves to 5; narrative states 6, 7, 8", 3: None, 4: None, 5: None}
    q = spark.createDataFrame([(1, "What was the net debt in 2031?"), (2, "the"), (3, None)], "query_id long, text string")
    labels = spark.createDataFrame([(7, "Net debt, adjusted"), (8, "Debt"), (9, None)], "table_id long, row_label string")
    assert rows(tables.covering_labels(q, labels)) == [(1, 7, "Net debt, adjusted")]


def test_anchored_documents_in_order(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "example_id long, anchor_id string, pos int")
    hits = spark.createDataFrame([("x", 20), ("y", 10), ("y", 20), ("x", 30)], "anchor_id string, doc_id long")
    corpus = spark.createDataFrame([(10, 0), (30, 1), (20, 2)], "doc_id long, pos int")
    assert rows(retrieval.anchored_documents(a, hits, corpus)) == [(1, 10, 2), (1, 20, 1), (1, 30, 0)]


def test_large_figures_are_written_out(spark):
    values = [1e23, 2.0**60, -(2.0**53), 9007199254740993.0, 123.45, 0.0, 1e30, -1.5e16]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", numbers.format_figure(F.col("v")).alias("t"))
    assert {r.i: r.t for r in df.collect()} == {i: (f"{v:.6f}".rstrip("0").rstrip(".") or "0") for i, v in enumerate(values)}


@pytest.mark.parametrize("spread", [0.05, 0.0005])
def test_places_go_to_few_cells_at_any_size(spark, spread):
    """Rows per place stay constant as places grow, also where all of them crowd; the join loses and doubles nothing."""
    rng = random.Random(2)
    rate = []
    for n in (4000, 16_000):
        side = spread * math.sqrt(n / 4000)
        points = spark.createDataFrame([(i, 41.8 + rng.uniform(-side, side), -87.6 + rng.uniform(-side, side)) for i in range(n)], "id long, lat double, lon double")
        places = proximity.cut(proximity._places(points))
        tree = spark.sparkContext.broadcast(proximity.choose_pivots(places, 200))
        rate.append(proximity._assigned(places, tree, F.lit(1.0)).count() / n)
    assert rate[1] < 1.3 * rate[0] and rate[1] < 2


def test_self_pairs_against_brute_force(spark):
    rng = random.Random(6)
    spots = [(41.8 + rng.uniform(-0.002, 0.002), rng.choice([-87.6, 179.9999, -179.9999]) + rng.uniform(-0.0005, 0.0005)) for _ in range(300)]
    points = [(i, *rng.choice(spots)) for i in range(500)] + [(900, None, 1.0), (7, 41.8, -87.6), (901, -0.0, 0.0001), (902, 0.0, 0.0001)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = rows(proximity.self_pairs_within(df, 25.0, leaf=20, block=30).select("a_id", "b_id"))
    want = []
    usable = [p for p in points if p[1] is not None]
    for i, a in enumerate(usable):
        for b in usable[i + 1 :]:
            h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
            if a[0] != b[0] and 2 * proximity.RADIUS_M * math.asin(math.sqrt(h)) <= 25:
                want.append((min(a[0], b[0]), max(a[0], b[0])))
    assert got == sorted(want)
