import math

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import encoding, numbers, text


def value(spark, column, **row):
    names, values = list(row), [tuple(row.values())]
    kinds = {str: "string", float: "double", int: "long", bool: "boolean", type(None): "string"}
    return spark.createDataFrame(values, ", ".join(f"{n} {kinds[type(v)]}" for n, v in row.items())).select(column.alias("x")).first().x if names else None


@pytest.mark.parametrize(
    ("raw", "hint", "want"),
    [
        ("1,234.5", 1000.0, 1234500.0),
        ("(12)", 1e6, -12e6),
        ("$4.1 billion", 1e3, 4.1e9),
        ("34.2%", 1e6, 34.2),
        ("7 years", 1e6, 7.0),
        ("-3", 1.0, -3.0),
        ("1842600000", 1.0, 1842600000.0),
        ("nothing", 1.0, None),
        ("", 1.0, None),
        (None, 1.0, None),
    ],
)
def test_parse_number(spark, raw, hint, want):
    assert value(spark, numbers.parse_number(F.col("t"), F.col("h")), t=raw, h=hint) == (pytest.approx(want) if want is not None else None)


def test_extract_numbers_keeps_order(spark):
    assert value(spark, numbers.extract_numbers(F.col("t")), t="sales of $1.2 million, (3) and 5%") == [1.2e6, -3.0, 5.0]
    assert value(spark, numbers.extract_numbers(F.col("t")), t=None) == []


def test_numeric_match_tolerates_half_a_percent(spark):
    same = numbers.numeric_match(F.col("a"), F.col("b"))
    assert value(spark, same, a="$1.23bn", b="1,234.5 million")
    assert not value(spark, same, a="1.20bn", b="1,234.5 million")
    assert not value(spark, same, a="none", b="1")
    assert not value(spark, same, a=None, b="1")


def test_cell_value_and_scale(spark):
    for raw in ("—", "n/a", " ", "--"):
        assert value(spark, numbers.cell_value(F.col("t"), F.lit(1000.0)), t=raw) is None
    scale = numbers.effective_scale(F.lit(None).cast("double"), F.col("u"), F.lit(1e6))
    assert value(spark, scale, u="percent") == 1.0
    assert value(spark, scale, u="USD") == 1e6


@pytest.mark.parametrize(("x", "want"), [(1.5, "1.5"), (2.0, "2"), (0.0, "0"), (-1.25, "-1.25"), (1234567.1234567, "1234567.123457"), (math.inf, "Infinity")])
def test_format_figure(spark, x, want):
    assert value(spark, numbers.format_figure(F.col("x")), x=x) == want


def test_boxes_and_masks(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])
    assert value(spark, numbers.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), z=1) == pytest.approx(1 / 7)
    assert value(spark, numbers.iou(box(0, 0, 1, 1), box(1, 1, 2, 2)), z=1) == 0.0
    grid = lambda rows: F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    assert value(spark, numbers.mask_iou(grid([[True, False], [True, True]]), grid([[True, True], [False, True]])), z=1) == 0.5
    assert value(spark, numbers.mask_area_m2(F.lit(100.0), F.lit(0.0), F.lit(10.0)), z=1) == 0.0
    assert value(spark, numbers.extent_cm(numbers.mask_area_m2(F.lit(100.0), F.lit(2.0), F.lit(10.0))), z=1) == pytest.approx(200 * math.sqrt(4 / math.pi))


def test_terms_and_words(spark):
    assert value(spark, text.terms(F.col("t")), t="The margin was 34.2 on 1,842.6, and IT fell") == ["margin", "34.2", "1,842.6", "fell"]
    assert value(spark, text.terms(F.col("t")), t=None) == []
    assert value(spark, text.question_words(F.col("t")), t="What was net sales, net of tax?") == ["net", "sales", "tax"]
    assert value(spark, text.report_words(F.col("t")), t="Please fix the big hole, big HOLE") == ["big", "hole"]


def test_set_scores(spark):
    a, b = F.split(F.col("a"), " "), F.split(F.col("b"), " ")
    assert value(spark, text.jaccard(a, b), a="x y z", b="y z w") == 0.5
    assert value(spark, text.token_f1(a, b), a="x y", b="y") == pytest.approx(2 / 3)
    assert value(spark, text.token_f1(a, b), a="x", b="y") == 0.0


def test_keys_ignore_spacing(spark):
    assert value(spark, text.text_key(F.col("t")), t="a  b\n") == value(spark, text.text_key(F.col("t")), t="a b")
    assert len(value(spark, text.pair_key(F.col("a"), F.col("b")), a="q", b="d")) == 32
    assert value(spark, text.pair_key(F.col("a"), F.col("b")), a="ab", b="c") != value(spark, text.pair_key(F.col("a"), F.col("b")), a="a", b="bc")


@pytest.mark.parametrize(("raw", "want"), [(" cik0000320193", "0000320193"), ("320193", "0000320193"), ("0", None), ("12x", None), (None, None)])
def test_normal_cik(spark, raw, want):
    assert value(spark, text.normal_cik(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Does management expect a recovery?", "cross_modal"),
        ("Is the table consistent with the call?", "cross_modal"),
        ("Why did margin fall?", "narrative"),
        ("What did the CFO say about pricing?", "narrative"),
        ("How much debt is due?", "numeric"),
        ("What was gross margin in 2030?", "numeric"),
        ("Was it above 5 percent?", "numeric"),
        ("Tell me of the plant.", "narrative"),
    ],
)
def test_route(spark, question, want):
    assert value(spark, text.route(F.col("t")), t=question) == want


def test_requested_year_and_items(spark):
    assert value(spark, text.requested_year(F.col("t")), t="fiscal 2031 or 2030") == "2031"
    assert value(spark, text.requested_year(F.col("t")), t="room 12031") is None
    assert value(spark, text.item_list(F.col("t")), t="1.01, ,9.01") == ["1.01", "9.01"]
    assert value(spark, text.archive_path(F.lit("0000000012"), F.lit("1-2-3"), F.lit("a.htm")), z=1) == "edgar/data/12/123/a.htm"


@pytest.mark.parametrize("plain", ["Café", "naïve – “quoted”", "Łodzin", "5 € und 3 ¢"])
@pytest.mark.parametrize("reader", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_repair_round_trip(plain, reader):
    try:
        garbled = plain.encode("utf-8").decode(reader)
    except UnicodeDecodeError:
        pytest.skip("that reader has no such byte")
    assert encoding.repair_text(garbled) == plain


def test_repair_leaves_good_text():
    for good in ("plain", "Café Łodzin", "", None, "報告：道路"):
        assert encoding.repair_text(good) == good
