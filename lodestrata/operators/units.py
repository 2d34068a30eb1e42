"""Printed figures in common units.

A figure's unit and scale may be stated by the cell, its row, its table (unit text, scale hint, caption) or its filing. Every
combination of a unit and a scale that is stated, or possible where nothing is, is a candidate, and the one with the least squared log
residuals holds. Statements weigh by how specific they are, each level infinitely more than the next, as the problem demands; the
combination that deviates least from them is therefore the most specific level's own, and needs no arithmetic where that level
states one unit and one scale. What statements leave open - a level that contradicts itself, a unit or a scale that no level
states - is solved by identities among quantities (`solve_combinations`): products and sums of a table's column
(`PRODUCTS`, `SUMS`), the physical dimension that a label has elsewhere, and the size of the issuer's other figures under the label. Where the
runner-up fits as well, the figure is flagged.

Cells are parsed once and kept; amounts are exact integers, rounded once at the end.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrata.functions.encoding import one_byte_readings, repair_text
from lodestrata.session import cut

#: Spelled unit -> (common unit, thousandths of the common unit in one of it).
UNITS = {
    "usd": ("USD", "1000"), "us$": ("USD", "1000"), "$": ("USD", "1000"), "u.s. dollars": ("USD", "1000"), "dollars": ("USD", "1000"),
    "per_share": ("USD_per_share", "1000"), "usd per share": ("USD_per_share", "1000"), "us$ per share": ("USD_per_share", "1000"), "$ per share": ("USD_per_share", "1000"), "per share": ("USD_per_share", "1000"),
    "cents": ("USD_per_share", "10"), "us cents per share": ("USD_per_share", "10"), "cents per share": ("USD_per_share", "10"), "¢": ("USD_per_share", "10"), "c": ("USD_per_share", "10"),
    "percent": ("percent", "1000"), "pct": ("percent", "1000"), "%": ("percent", "1000"),
    "bps": ("percent", "10"), "bp": ("percent", "10"), "basis points": ("percent", "10"), "basis point": ("percent", "10"),
    "count": ("count", "1000"), "shares": ("count", "1000"), "employees": ("count", "1000"), "people": ("count", "1000"),
    "ratio": ("ratio", "1000"), "x": ("ratio", "1000"), "×": ("ratio", "1000"), "times": ("ratio", "1000"),
    "duration": ("months", "1000"), "months": ("months", "1000"), "month": ("months", "1000"), "mo.": ("months", "1000"), "mo": ("months", "1000"),
    "years": ("months", "12000"), "year": ("months", "12000"), "yrs": ("months", "12000"), "yr": ("months", "12000"),
    "quarters": ("months", "3000"), "quarter": ("months", "3000"),
    "kwh": ("kWh", "1000"), "mwh": ("kWh", "1000000"), "gwh": ("kWh", "1000000000"), "tj": ("kWh", "10000000000/36"),
    "kg": ("kg", "1000"), "t": ("kg", "1000000"), "tonnes": ("kg", "1000000"), "tonne": ("kg", "1000000"), "kt": ("kg", "1000000000"),
    "lb": ("kg", "453.59237"), "lbs": ("kg", "453.59237"), "short tons": ("kg", "907184.74"), "short ton": ("kg", "907184.74"),
    "m2": ("m2", "1000"), "sq m": ("m2", "1000"), "m²": ("m2", "1000"), "sq ft": ("m2", "92.90304"),
    "acres": ("m2", "4046856.4224"), "acre": ("m2", "4046856.4224"), "ha": ("m2", "10000000"),
}
#: Scale word -> factor.
SCALES = {
    "k": 1e3, "thousand": 1e3, "thousands": 1e3, "000": 1e3,
    "m": 1e6, "mm": 1e6, "mn": 1e6, "million": 1e6, "millions": 1e6,
    "bn": 1e9, "bln": 1e9, "billion": 1e9, "billions": 1e9, "trillion": 1e12, "trillions": 1e12, "tn": 1e12,
}
#: Units whose rows take no scale from table or filing.
OWN_SCALE = ["percent", "count", "USD_per_share", "months", "ratio"]
#: Scales that a figure may have for which none is stated.
POSSIBLE = [1.0, 1e3, 1e6, 1e9]

#: Identities that hold between labels of one table column, in common units. PRODUCTS: exponents, and the factor that the product of
#: powers equals (a margin is in percent). SUMS: coefficients of amounts that add up to nothing.
PRODUCTS = (
    ({"gross profit": 1.0, "net sales": -1.0, "gross margin": -1.0}, 0.01),
    ({"net earnings": 1.0, "diluted earnings per share": -1.0, "diluted weighted shares": -1.0}, 1.0),
    ({"operating profit": 1.0, "interest paid": -1.0, "interest cover": -1.0}, 1.0),
)
SUMS = ({"net sales": 1.0, "cost of goods sold": -1.0, "gross profit": -1.0},)
#: Relative error of printed figures in an identity, least spread of an issuer's figures, and by how much the runner-up's weighted
#: squared residuals must exceed the best's (twice the log of 20) for the best to be the only one. Share of a label's clear figures
#: that must have one dimension for a figure without a unit to have it for sure.
PRINT_ERROR, LEAST_SPREAD, MARGIN, DIMENSION = 0.02, 0.25, 6.0, 0.9

_SCALE_WORD = r"(\b(?:thousands?|millions?|billions?|trillions?|bln|bn|mn|mm|000)\b|(?<=usd |\$ )[km]\b)"
_NUMBER = r"\d{1,3}(?:[ ,'’]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+"
_SIGN = r"(?:us\$|usd|\$)?\s*"
#: sign or bracket, number, scale word, unit
_FIGURE = r"^([-(]?)\s*" + _SIGN + r"([-(]*)\s*" + _SIGN + "(" + _NUMBER + r")\s*(?:((?:thousand|million|billion|trillion)s?|bln|bn|mn|mm|tn|k|m)\b)?\s*([^\d()]*?2?)\s*\)?\s*$"
_FOOTNOTE = r"(?<=[\p{L}\d)%¢×.])(?:\s*(?:\(\d{1,2}\)|\[\w{1,2}\]|\*+|†+|‡+|[¹²³⁰-⁹]+)){1,2}$"
#: White space other than the blank.
BLANKS = "\t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters beyond ASCII that sound cells hold: signs, marks and blanks.
_SOUND = "−–—·’¢×¹²³⁰⁴-⁹†‡" + BLANKS
_MARK = "\x01"


def _factor(thousandths: str) -> tuple[int, int, int]:
    """(mantissa, power of ten, divisor) of a unit's thousandths, as integers."""
    number, _, divisor = thousandths.partition("/")
    sign, digits, power = Decimal(number).normalize().as_tuple()
    return int("".join(map(str, digits))), int(power), int(divisor or 1)


def _sql_map(pairs: dict[str, str]) -> str:
    quoted = ", ".join("'" + k.replace("'", "\\'") + "', " + v for k, v in pairs.items())
    return f"map({quoted})"


def _facts() -> str:
    """The fixed map of unit words: struct(unit, mantissa, power, divisor, log of the common unit's amount in one)."""
    pairs = {}
    for word, (unit, thousandths) in UNITS.items():
        m, p, d = _factor(thousandths)
        size = math.log(m) + (p - 3) * math.log(10) - math.log(d)
        pairs[word] = f"named_struct('unit', '{unit}', 'm', {m}L, 'p', {p}, 'd', {d}, 'log', {size!r}D)"
    return _sql_map(pairs)


_FACTS, _SCALES = _facts(), _sql_map({k: f"{v!r}D" for k, v in SCALES.items()})


def _fact(word: Column) -> Column:
    return F.try_element_at(F.expr(_FACTS), word)


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), BLANKS, " " * len(BLANKS)), " +", " "))


def _scale_in(text: Column) -> Column:
    return F.try_element_at(F.expr(_SCALES), F.nullif(F.regexp_extract(_clean(text), _SCALE_WORD, 1), F.lit("")))


def _unit_in(text: Column) -> Column:
    """The unit word of a unit text, without scale words: 'thousand kg', 'millions of US$', 'USD m', 'KWH'."""
    plain = F.regexp_replace(_clean(text), r"\b(?:thousands?|millions?|billions?|trillions?)(?: of)?\b|(?<=usd )(?:k|m|mm|mn|bn|bln)$", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _caption_unit(caption: Column) -> Column:
    """A unit named in the caption's last brackets or after its last comma, else null."""
    inner = F.regexp_extract(_clean(caption), r"[(\[,—]\s*([^()\[\],—]+?)\s*[)\]]?$", 1)
    word = _unit_in(F.regexp_replace(inner, r"\s+in\s+(?=thousand|million|billion|trillion)", " "))
    return F.when(_fact(word).isNotNull(), word)


def _stated(*scales: Column) -> Column:
    """The distinct scales among statements; null, zero, negative and non-finite ones state nothing."""
    return F.array_distinct(F.filter(F.array(*scales), lambda x: (x > 0) & (x < float("inf")) & ~F.isnan(x)))


@F.pandas_udf(T.StringType())
def _ungarble(raws):
    """Repairs the few cells with odd characters; a one-byte mix-up is undone only if a plain figure comes out."""
    import re

    grammar = re.compile(r"[-−(]?\s*(?:US\$|USD|\$)?\s*[-−(]*\s*\d[\d.,’\s  ]*(?:¢|×|%|[A-Za-z %]*)\s*\)?\s*[¹²³]?")
    known = set("−’¹²³×¢\u00a0\u202f·—–")

    def one(raw):
        if raw is None:
            return None
        text = repair_text(raw)
        if any(ord(c) > 127 and c not in known for c in text):
            for reading in ("".join(x) for x in _readings(text)):
                if grammar.fullmatch(reading):
                    return reading
        return text

    def _readings(text):
        parts = re.split(r"([^\x00-\x7f]+)", text)
        options = [one_byte_readings(p) if i % 2 else [p] for i, p in enumerate(parts)]
        longest = max(len(o) for o in options)
        for n in range(longest):
            yield [o[min(n, len(o) - 1)] if o else p for o, p in zip(options, parts, strict=True)]

    return raws.map(one)


def parse_figures(cells: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds digits (of the figure, without its point), places (behind the point), negative, said_unit, said_scale per printed cell; digits
    is null where no figure is stated.

    Nil marks, remarks, blanks and nulls state none. Footnote marks are dropped. A minus of any kind or brackets make the figure negative.
    A currency sign alone is neither unit nor scale. Figures are of any length: nothing is rounded here.
    """
    odd = F.col(raw).rlike(rf"[^\x00-\x7F{_SOUND}]")
    text = F.coalesce(_ungarble(F.when(odd, F.col(raw))), F.col(raw))
    text = F.translate(text, BLANKS + "−–" + _MARK, " " * len(BLANKS) + "--")
    df = cells.withColumn("_t", F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, " +", " ")), _FOOTNOTE, ""))))
    df = df.withColumn("_p", F.split(F.regexp_replace("_t", _FIGURE, f"{_MARK}$1$2{_MARK}$3{_MARK}$4{_MARK}$5"), _MARK, 5)).drop("_t")
    part = lambda n: F.get("_p", F.lit(n))
    known = _fact(F.trim(part(4))).isNotNull()
    df = df.withColumn("_good", (F.size("_p") == 5) & ((F.trim(part(4)) == "") | known))
    number = F.translate(part(2), " ,'’", "")
    point = F.instr(number, ".")
    df = df.withColumns({
        "digits": F.when(F.col("_good"), F.translate(number, ".", "")), "places": F.when(F.col("_good"), F.when(point > 0, F.length(number) - point).otherwise(0)),
        "negative": F.col("_good") & (part(1) != ""), "said_scale": F.when(F.col("_good"), F.try_element_at(F.expr(_SCALES), part(3))), "said_unit": F.when(F.col("_good") & known, F.trim(part(4))),
    })
    return df.drop("_p", "_good")


def with_amounts(figures: DataFrame, word: str = "word", scale: str = "scale") -> DataFrame:
    """Adds amount_milli: the figure in thousandths of its common unit as a bigint, halves rounded away from zero; null where a
    bigint can't hold it.

    digits / 10^places x scale x m x 10^p / d is one quotient of integers, so that nothing is rounded before the last step and nothing
    overflows. Of figures of more than 25 digits the rest only tells whether there is one.
    """
    whole, long = F.regexp_replace("digits", "^0+", ""), F.length("_w") > 25
    rest = F.when(F.substring(F.col("_w"), 25, 1 << 30).rlike("[1-9]"), "1").otherwise("0")
    number = lambda c: c.try_cast("decimal(38,0)")
    ten = lambda n: number(F.rpad(F.lit("1"), (F.least(n, F.lit(38)) + 1).cast("int"), F.lit("0")))
    df = figures.withColumns({"_w": whole, "_f": _fact(F.col(word)), "_s": F.translate(F.format_string("%.6f", scale), ".", "")})
    df = df.withColumns({"_k": F.when(F.col("_w") == "", "0").when(long, F.concat(F.substring("_w", 1, 24), rest)).otherwise(F.col("_w")), "_m": F.regexp_replace("_s", "0+$", "")})
    shift = F.col("_f.p") + F.length("_s") - F.length("_m") - 6 - F.col("places") + F.when(long, F.length("_w") - 25).otherwise(0)
    times = F.try_multiply(number(F.try_multiply(number(F.col("_k")), number(F.col("_f.m").cast("string")))), number(F.col("_m")))
    df = df.withColumns({"_n": number(times), "_e": shift})
    df = df.withColumns({"_n": F.when(F.col("_n") == 0, F.col("_n")).otherwise(number(F.try_multiply("_n", ten(F.greatest("_e", F.lit(0)))))), "_d": number(F.try_multiply(ten(F.greatest(-F.col("_e"), F.lit(0))), number(F.col("_f.d").cast("string"))))})
    df = df.withColumn("_r", F.try_mod("_n", "_d"))
    held = F.col("_n").cast("double") < F.col("_d").cast("double") * 9.2e18
    size = F.when(F.col("_e") < -36, F.lit(0).cast("bigint")).when(held, F.expr("_n div _d") + F.when(F.col("_r") >= F.col("_d") - F.col("_r"), 1).otherwise(0))
    return df.withColumn("amount_milli", F.when(F.col("negative"), -size).otherwise(size)).drop("_w", "_f", "_s", "_k", "_m", "_n", "_e", "_d", "_r")


def solve_combinations(values: DataFrame, candidates: DataFrame, by: list[str], identities: list[dict[str, float]], margin: float = MARGIN) -> DataFrame:
    """Per group the candidate factor of every quantity such that the identities hold best.

    values: by..., quantity, obs, log_value (natural log of a positive figure), optionally weight (of the observation, by default
    that of figures printed with PRINT_ERROR); candidates: by..., quantity, option, log_factor.
    An identity {q: e} says sum of e * log(q) = 0 in common units, as {"mass": 1, "density": -1, "volume": -1}.
    Returns by..., choice (map quantity -> option), residual (weighted mean of squares), unique (false if another combination's weighted
    squares are within `margin` of the best's). Observations are reduced to sums before combinations are made, whose number depends on
    the options only. Groups without a complete observation keep residual 0 and are unique only if one combination exists. Nulls
    are ignored.
    """
    names = sorted({q for i in identities for q in i})
    parts = [F.struct(F.lit(n).alias("n"), *[F.lit(float(i.get(q, 0.0))).alias(f"e{k}") for k, q in enumerate(names)]) for n, i in enumerate(identities)]
    weight = F.max("weight") if "weight" in values.columns else F.lit(PRINT_ERROR**-2)
    wide = values.filter(F.col("log_value").isNotNull()).groupBy(*by, "obs").agg(weight.alias("w"), *[F.avg(F.when(F.col("quantity") == q, F.col("log_value"))).alias(f"v{k}") for k, q in enumerate(names)])
    each = wide.withColumn("i", F.explode(F.array(*parts)))
    left = reduce(lambda a, b: a + b, [F.when(F.col(f"i.e{k}") == 0, F.lit(0.0)).otherwise(F.col(f"i.e{k}") * F.col(f"v{k}")) for k in range(len(names))])
    sums = each.withColumn("x", left).filter("x is not null and w > 0").groupBy(*by, F.col("i.n").alias("n"), *[F.col(f"i.e{k}").alias(f"e{k}") for k in range(len(names))])
    sums = sums.agg(F.sum("w").alias("c"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"))
    combos = None
    for k, q in enumerate(names):
        options = candidates.filter(F.col("quantity") == q).select(*by, F.col("option").alias(f"o{k}"), F.col("log_factor").alias(f"f{k}")).distinct()
        combos = options if combos is None else combos.join(options, by)
    shift = reduce(lambda a, b: a + b, [F.col(f"e{k}") * F.col(f"f{k}") for k in range(len(names))])
    fit = combos.join(sums, by, "left").withColumn("s", shift)
    loss = F.sum(F.col("sxx") + 2 * F.col("s") * F.col("sx") + F.col("c") * F.col("s") * F.col("s"))
    keys = [f"{p}{k}" for k in range(len(names)) for p in "of"]
    fit = fit.groupBy(*by, *keys).agg(F.coalesce(loss, F.lit(0.0)).alias("loss"), F.sum("c").alias("weights"))
    order = Window.partitionBy(*by).orderBy("loss", *[f"o{k}" for k in range(len(names))])
    fit = fit.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("loss").over(order))
    choice = F.create_map(*[x for k, q in enumerate(names) for x in (F.lit(q), F.col(f"o{k}"))])
    residual = F.coalesce(F.col("loss") / F.col("weights"), F.lit(0.0))
    return fit.filter("rank = 1").select(*by, choice.alias("choice"), residual.alias("residual"), (F.col("next").isNull() | (F.col("next") > F.col("loss") + margin)).alias("unique"))


def label_of(row_label: Column) -> Column:
    """A row's label without case and without what is said behind it: 'Treasury shares (in thousands)' and 'TREASURY SHARES — thousands'."""
    return F.regexp_replace(_clean(row_label), r"\s*[(,—].*$", "")


def _statements(cells: DataFrame, tables: DataFrame, filings: DataFrame) -> DataFrame:
    """Per stated figure: its number, label, the most specific unit word (null if none), and the scales of the most specific level that
    states any (none if no level does)."""
    t = tables.select(F.col("id").alias("table_id"), "document_id", F.col("scale_hint").alias("_hint"), F.col("unit").alias("_tunit"), F.col("caption").alias("_cap"))
    f = filings.select(F.col("id").alias("document_id"), F.col("scale_hint").alias("_fscale"))
    t = t.join(f, "document_id", "left").drop("document_id")
    t = t.withColumn("_tscales", _stated(_scale_in(F.col("_tunit")), F.col("_hint"), _scale_in(F.col("_cap"))))
    t = t.withColumn("_tunit", F.coalesce(F.nullif(_unit_in(F.col("_tunit")), F.lit("")), _caption_unit(F.col("_cap")))).withColumn("_fscales", _stated(F.col("_fscale"))).drop("_hint", "_cap", "_fscale")
    p = parse_figures(cells.filter("not is_header").select("cell_id", "cik", "table_id", "col_idx", "row_label", "row_unit", "row_scale", "raw")).filter("digits is not null").drop("raw")
    p = p.join(t, "table_id", "left")
    label_scale = _scale_in(F.regexp_extract(F.col("row_label"), r"(?i)[(,—-]\s*(?:in )?(thousands?|millions?|billions?)\)?\s*$", 1))
    p = p.withColumn("_runit", F.nullif(_unit_in(F.col("row_unit")), F.lit("")))
    # ¢ says hundredths, of what the row says if that isn't money per share
    hundredths = F.col("said_unit").isin("c", "¢") & (F.coalesce(_fact(F.col("_runit"))["unit"], F.lit("USD_per_share")) != "USD_per_share")
    word = F.coalesce(F.when(hundredths, F.col("_runit")), F.col("said_unit"), F.col("_runit"), F.col("_tunit"))
    p = p.withColumn("word", F.when(_fact(word).isNotNull(), word).when(word.isNotNull(), "usd"))
    one, nothing = F.array(F.lit(1.0)), F.array().cast("array<double>")
    row_scales = _stated(F.col("row_scale"), label_scale, _scale_in(F.col("row_unit")))
    scales = (
        F.when(F.col("said_scale").isNotNull(), F.array("said_scale"))
        .when(F.col("said_unit").isNotNull(), one)
        .when(F.size(row_scales) > 0, row_scales)
        .when(_fact(F.col("word"))["unit"].isin(OWN_SCALE), one)
        .when(F.size("_tscales") > 0, F.col("_tscales"))
        .when(F.size("_fscales") > 0, F.col("_fscales"))
        .otherwise(nothing)
    )
    return p.select("cell_id", "cik", "table_id", "col_idx", label_of(F.col("row_label")).alias("label"), "digits", "places", "negative", "word", scales.alias("scales"))


def _size(places: Column, digits: Column) -> Column:
    """log of the figure; null for zero."""
    value = F.concat(digits, F.lit("e"), (-places).cast("string")).try_cast("double")
    return F.when((value > 0) & (value < float("inf")), F.log(value))


def _identity_roles() -> str:
    """label -> array of struct(n, kind, e, parts, constant) over the fixed identities, as SQL."""
    roles: dict[str, list[str]] = {}
    for n, (kind, powers, constant) in enumerate([*(("product", p, math.log(c)) for p, c in PRODUCTS), *(("sum", s, 0.0) for s in SUMS)]):
        for label, e in powers.items():
            roles.setdefault(label, []).append(f"named_struct('n', {n}, 'kind', '{kind}', 'e', {e!r}D, 'parts', {len(powers)}, 'constant', {constant!r}D)")
    return _sql_map({label: f"array({', '.join(rows)})" for label, rows in roles.items()})


def _column_observations(figures: DataFrame, open_: DataFrame) -> DataFrame:
    """key, obs, printed (log that the open key's factor must cancel), weight: the identities of the table columns that hold open figures.

    A column speaks only if every part of the identity stands in it once, and all open parts share one key; then the identity is linear in
    the log of that key's factor.
    """
    roles = F.try_element_at(F.expr(_identity_roles()), F.col("label"))
    columns = open_.select("table_id", "col_idx").distinct()
    near = figures.filter(roles.isNotNull()).join(columns, ["table_id", "col_idx"], "left_semi").join(open_.select("cell_id", "key"), "cell_id", "left")
    near = near.withColumn("log", _size(F.col("places"), F.col("digits")) + F.when(F.col("key").isNull(), _fact(F.col("word"))["log"] + F.log(F.col("scales")[0])).otherwise(0.0))
    near = near.select("table_id", "col_idx", "label", "key", "negative", "log", F.explode(roles).alias("r"))
    once = near.groupBy("table_id", "col_idx", "r", "label").agg(F.min("log").alias("log"), F.max("log").alias("most"), F.min("negative").alias("negative"), F.max("negative").alias("negative2"), F.min("key").alias("key"), F.max("key").alias("key2"))
    once = once.filter("log = most and negative = negative2 and (key <=> key2)")
    amount = F.col("r.e") * F.exp("log") * F.when(F.col("negative"), -1.0).otherwise(1.0)
    each = once.groupBy("table_id", "col_idx", F.col("r.n").alias("n"), F.col("r.kind").alias("kind"), F.col("r.parts").alias("parts"), F.col("r.constant").alias("constant")).agg(
        F.count("*").alias("there"), F.min("key").alias("key"), F.max("key").alias("key2"), F.sum(F.when(F.col("key").isNotNull(), F.col("r.e")).otherwise(0.0)).alias("power"), F.sum(F.col("r.e") * F.col("log")).alias("logs"),
        F.sum(F.when(F.col("key").isNotNull(), amount).otherwise(0.0)).alias("open"), F.sum(F.when(F.col("key").isNull(), amount).otherwise(0.0)).alias("clear"),
    )
    each = each.filter("there = parts and key is not null and key = key2")
    product = F.when(F.col("power") != 0, (F.col("logs") - F.col("constant")) / F.col("power"))
    total = F.when((F.col("open") != 0) & (-F.col("clear") / F.col("open") > 0), -F.log(-F.col("clear") / F.col("open")))
    weight = F.when(F.col("kind") == "product", F.col("power") * F.col("power")).otherwise(1.0) / PRINT_ERROR**2
    obs = F.concat_ws(" ", F.lit("column"), "table_id", "col_idx", "n")
    return each.select("key", obs.alias("obs"), F.when(F.col("kind") == "product", product).otherwise(total).alias("printed"), weight.alias("weight")).filter("printed is not null")


def _settle(figures: DataFrame, open_: DataFrame) -> DataFrame:
    """cell_id, word, scale, unique of the figures that statements leave open, solved by identities.

    Every figure's combinations become options; figures of one table with the same options share one choice. Observations are what a
    column's identities say, and how the issuer's clear figures (else all issuers') under the same label compare in size.
    """
    clear = figures.filter(F.col("word").isNotNull() & (F.size("scales") == 1) & F.col("label").isNotNull()).join(open_.select("label").distinct(), "label", "left_semi")
    fact = _fact(F.col("word"))
    size = _size(F.col("places"), F.col("digits")) + fact["log"] + F.log(F.col("scales")[0])
    seen = clear.select("cik", "label", "word", fact["unit"].alias("unit"), size.alias("x")).groupBy("cik", "label", "unit", "word").agg(F.count("*").alias("n"), F.count("x").alias("nx"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    seen = cut(seen)
    # the dimension that the label has elsewhere, and one word for every size of unit it is said in
    sizes = seen.groupBy("label", "unit", _fact(F.col("word"))["log"].alias("log")).agg(F.sum("n").alias("n"), F.min("word").alias("word"))
    dims = sizes.groupBy("label", "unit").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("word")).alias("words"))
    dims = dims.groupBy("label").agg(F.max_by(F.struct("unit", "words"), F.struct("n", "unit")).alias("d"), (F.max("n") >= F.sum("n") * DIMENSION).alias("one"))
    o = open_.join(dims, "label", "left")
    words = F.when(F.col("word").isNotNull(), F.array("word")).otherwise(F.coalesce(F.col("d.words"), F.array(F.lit("usd"))))
    usual = F.when(F.col("word").isNotNull(), F.col("word")).when(F.col("d").isNull() | (F.col("d.unit") == "USD"), "usd").otherwise(F.col("d.words")[0])
    o = o.withColumns({"_words": words, "_usual": usual})
    o = o.withColumn("unit", _fact(F.col("_usual"))["unit"]).withColumn("sure", F.col("word").isNotNull() | F.coalesce("one", F.lit(False)))
    o = o.withColumn("_alone", F.size("scales") == 0)
    free = F.when(F.col("unit").isin(OWN_SCALE), F.array(F.lit(1.0))).otherwise(F.array(*map(F.lit, POSSIBLE)))
    o = o.withColumn("_scales", F.when(F.col("_alone"), free).otherwise(F.col("scales")))
    pairs = F.flatten(F.transform("_words", lambda w: F.transform("_scales", lambda s: F.struct(w.alias("word"), s.alias("scale")))))
    o = o.withColumn("options", pairs).withColumn("key", F.concat_ws("|", F.coalesce(F.col("table_id").cast("string"), F.lit("")), F.to_json("options"), F.col("_usual")))
    o = cut(o.select("cell_id", "cik", "table_id", "col_idx", "label", "digits", "places", "unit", "sure", "_alone", "_usual", "options", "key"))
    moments = lambda *by: seen.groupBy(*by).agg((F.sum("sx") / F.sum("nx")).alias("mean"), F.greatest(F.sum("sxx") / F.sum("nx") - F.pow(F.sum("sx") / F.sum("nx"), 2), F.lit(LEAST_SPREAD**2)).alias("spread")).filter("mean is not null")
    own = moments("cik", "label", "unit").select("cik", "label", "unit", F.struct("mean", "spread").alias("own"))
    every = moments("label", "unit").select("label", "unit", F.struct("mean", "spread").alias("every"))
    yard = o.join(own, ["cik", "label", "unit"], "left").join(every, ["label", "unit"], "left").withColumn("y", F.coalesce("own", "every"))
    yard = yard.select("key", F.concat_ws(" ", F.lit("size"), "cell_id").alias("obs"), (_size(F.col("places"), F.col("digits")) - F.col("y.mean")).alias("printed"), (1.0 / F.col("y.spread")).alias("weight")).filter("printed is not null")
    observed = yard.unionByName(_column_observations(figures, o))
    values = observed.select("key", "obs", "weight", F.explode(F.array(F.struct(F.lit("printed").alias("quantity"), F.col("printed").alias("log_value")), F.struct(F.lit("known").alias("quantity"), F.lit(0.0).alias("log_value")))).alias("v")).select("key", "obs", "weight", "v.*")
    keys = o.select("key", "options", "_alone", "_usual").distinct()
    each = keys.select("key", F.explode("options").alias("x"))
    none = F.struct(F.lit("").alias("word"), F.lit(1.0).alias("scale"))
    candidates = each.select("key", F.lit("printed").alias("quantity"), F.col("x").alias("option"), (_fact(F.col("x.word"))["log"] + F.log("x.scale")).alias("log_factor")).unionByName(keys.select("key", F.lit("known").alias("quantity"), none.alias("option"), F.lit(0.0).alias("log_factor")))
    solved = solve_combinations(values, candidates, ["key"], [{"printed": 1.0, "known": -1.0}]).select("key", F.col("choice")["printed"].alias("best"), "unique")
    out = o.select("cell_id", "key", "sure", "_alone", "_usual", "options").join(solved, "key", "left")
    # where nothing is stated and the best isn't the only one, the usual unit and scale stay
    kept = F.when(F.col("unique") | ~F.col("_alone"), F.col("best")).otherwise(F.struct(F.col("_usual").alias("word"), F.lit(1.0).alias("scale")))
    return out.select("cell_id", kept.alias("b"), (F.col("unique") & F.col("sure")).alias("unique")).select("cell_id", "b.word", "b.scale", "unique")


def common_units(cells: DataFrame, tables: DataFrame, filings: DataFrame) -> DataFrame:
    """One row per non-header cell that states a figure: cell_id, unit, amount_milli, unique, solved.

    Cells whose table or filing is missing go by what cell and row say. `solved` tells that statements left the figure open, so that
    identities decided; `unique` is false where another combination fits them as well. An unknown unit word is taken for money. An
    amount that a bigint can't hold is null. Repeated cell ids give repeated rows, and so do those of tables and filings; null ids never join.
    """
    figures = cut(_statements(cells, tables, filings))  # parsed once
    left_open = F.col("word").isNull() | (F.size("scales") != 1)
    clear = figures.filter(~left_open).select("cell_id", "digits", "places", "negative", "word", F.col("scales")[0].alias("scale"), F.lit(True).alias("unique"), F.lit(False).alias("solved"))
    # rows of one cell id that differ are solved apart
    rest = figures.filter(left_open)
    if rest.isEmpty():
        every = clear
    else:
        rest = cut(rest.withColumn("own", F.col("cell_id")).withColumn("cell_id", F.monotonically_increasing_id()))
        found = _settle(figures.filter(~left_open).withColumn("cell_id", F.lit(None).cast("bigint")).unionByName(rest.drop("own")), rest.drop("own"))
        solved = rest.select("cell_id", "own", "digits", "places", "negative").join(found, "cell_id")
        every = clear.unionByName(solved.select(F.col("own").alias("cell_id"), "digits", "places", "negative", "word", "scale", "unique", F.lit(True).alias("solved")))
    every = with_amounts(every.withColumn("unit", _fact(F.col("word"))["unit"]))
    return every.select("cell_id", "unit", "amount_milli", "unique", "solved")
