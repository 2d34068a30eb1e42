"""Number expressions: printed figures, geometry of boxes and masks, costs, all as columns inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that scale a figure, and suffixes that name its unit, so that it is written in full.
SUFFIX_SCALES = {
    "hundred": 1e2, "k": 1e3, "thousand": 1e3, "thousands": 1e3, "m": 1e6, "mm": 1e6, "million": 1e6, "millions": 1e6,
    "b": 1e9, "bn": 1e9, "billion": 1e9, "billions": 1e9, "t": 1e12, "trillion": 1e12,
}
UNIT_WORDS = ("year", "years", "month", "months", "day", "days", "week", "weeks", "share", "shares", "employee", "employees", "x")
NIL_MARKS = ("-", "--", "—", "n/a", "N/A")
#: Units of rows that take no scale from their table.
UNSCALED = ("percent", "count", "ratio", "per_share", "duration")

#: Fixed value: opening bracket, sign, digits, suffix and closing bracket of a figure.
FIGURE = r"(\()?\s*[$€£]?\s*([-+])?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|[a-zA-Z]+)?\s*(\))?"


def parse_number(text: Column, scale_hint: Column | None = None) -> Column:
    """The first figure of a text as a double; null if there is none.

    A scale word beats the hint, a percent sign or unit word bars it. A minus or a pair of brackets makes the figure negative.
    """
    hint = F.lit(1.0) if scale_hint is None else scale_hint
    part = lambda n: F.regexp_extract(text, FIGURE, n)
    suffix = F.lower(part(4))
    scales = F.create_map(*[F.lit(x) for pair in SUFFIX_SCALES.items() for x in pair])
    scale = F.when(suffix.isin("%", *UNIT_WORDS), F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(scales, suffix), hint))
    value = F.replace(part(3), F.lit(","), F.lit("")).try_cast("double") * scale
    return F.when((part(2) == "-") | ((part(1) != "") & (part(5) != "")), -value).otherwise(value)


def extract_numbers(text: Column, scale_hint: Column | None = None) -> Column:
    """Every figure of a text, in order; an empty array for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0)), lambda x: parse_number(x, scale_hint))


def numeric_match(predicted: Column, gold: Column, scale_hint: Column | None = None, rel_tol: float = 0.005, abs_tol: float = 0.0) -> Column:
    """Whether two printed figures agree within tolerance; false if either is no figure."""
    p, g = parse_number(predicted, scale_hint), parse_number(gold, scale_hint)
    return F.coalesce(F.abs(p - g) <= F.greatest(F.lit(abs_tol), rel_tol * F.abs(g)), F.lit(False))


def cell_value(raw: Column, scale: Column) -> Column:
    """A table cell's figure; null for nil marks, blanks and text without one."""
    plain = F.trim(raw)
    return F.when(~plain.isin("", *NIL_MARKS), parse_number(plain, scale))


def effective_scale(row_scale: Column, unit: Column, table_scale: Column) -> Column:
    """The row's own scale, else 1 for units that take none, else the table's, else 1."""
    return F.coalesce(row_scale, F.when(unit.isin(*UNSCALED), F.lit(1.0)), table_scale, F.lit(1.0))


def format_figure(value: Column) -> Column:
    """Up to six decimals, trailing zeros dropped; digits of large values are those of the double itself."""
    text = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    # beyond 2^53 a double is a whole number times a power of two, which a decimal holds exactly
    power = F.floor(F.log2(F.abs(value))).cast("int") - 52
    whole = (value / F.pow(F.lit(2.0), power)).cast("bigint").cast("decimal(19,0)")
    exact = F.try_multiply(whole, F.call_function("shiftleft", F.lit(1).cast("bigint"), power).cast("decimal(19,0)"))
    large = (F.abs(value) >= 2.0**53) & (F.abs(value) < 2.0**114)
    text = F.when(large, exact.cast("decimal(38,0)").cast("string")).otherwise(F.when(text.isin("", "-"), "0").otherwise(text))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value.cast("string")).otherwise(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays of one length; null if either is null, of another length or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def rescaled_similarity(cosine_: Column, floor: float) -> Column:
    """A cosine stretched from [floor, 1] to [0, 1]; 0 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine_ - floor) / (1 - floor))), F.lit(0.0))


def bounding_box(lat: Column, lon: Column, radius_m: Column) -> Column:
    """struct(west, south, east, north) in degrees around a point, at 111,320 m a degree."""
    dlat = radius_m / 111_320.0
    dlon = radius_m / (111_320.0 * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-6)))
    return F.struct((lon - dlon).alias("west"), (lat - dlat).alias("south"), (lon + dlon).alias("east"), (lat + dlat).alias("north"))


def focal_px(width: Column, fov_degrees: float = 70.0) -> Column:
    return width / 2.0 / math.tan(math.radians(fov_degrees) / 2)


def mask_area_m2(mask_px: Column, depth_m: Column, focal: Column, oblique: float = 1.0) -> Column:
    """Area that a mask covers at a depth; 0 unless everything is positive."""
    good = (mask_px > 0) & (depth_m > 0) & (focal > 0)
    return F.when(good, mask_px * F.pow(depth_m / focal, 2) * oblique).otherwise(F.lit(0.0))


def extent_cm(area_m2: Column) -> Column:
    """Diameter in cm of the circle of an area."""
    return 200.0 * F.sqrt(area_m2 / math.pi)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes struct(x1, y1, x2, y2) over their union; 0 where there is none."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    shared = side("x1", "x2") * side("y1", "y2")
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def mask_iou(a: Column, b: Column) -> Column:
    """Overlap of two boolean grids over their union; 0 where both are empty."""
    flat = F.zip_with(F.flatten(a), F.flatten(b), lambda p, q: F.struct((p & q).cast("int").alias("both"), (p | q).cast("int").alias("any")))
    total = lambda name: F.aggregate(flat, F.lit(0), lambda s, v: s + v[name])
    return F.when(total("any") > 0, total("both") / total("any")).otherwise(F.lit(0.0))
