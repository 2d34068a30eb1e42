"""Text expressions: tokens, keys, identifiers and routing, all as columns inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval, table questions and street reports ignore.
STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the to was were will with".split()
FILLER_WORDS = (
    "what was were is are the a an in of for how much many did do does on at to and we our us company total this that from by with be been had has have there it "
    "its their any which when during as into over"
).split()
NOISE_WORDS = "the a an of on at in near by and to is are was were please fix report reported there this that it its my our".split()

#: A word; a word with the decimals or further groups of a number; a year that a question names.
WORD = "[a-z0-9]+"
TERM = r"[a-z0-9]+(?:[.,][0-9]+)*"
NAMED_YEAR = r"(?i)\b(?:fiscal\s+|fy\s*)?((?:19|20)\d{2})\b"


def _tokens(text: Column, pattern: str, without: list[str]) -> Column:
    """Tokens in order, repeats kept; an empty array for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, without))) if not without else F.filter(found, lambda t: ~t.isin(*without))


def terms(text: Column) -> Column:
    """Retrieval terms: '34.2' and '1,842.6' stay whole."""
    return _tokens(text, TERM, STOPWORDS)


def question_words(text: Column) -> Column:
    """Content words of a question, a label or a caption, each once."""
    return F.array_distinct(_tokens(text, WORD, FILLER_WORDS))


def report_words(text: Column) -> Column:
    """Content words of a street report, each once."""
    return F.array_distinct(_tokens(text, WORD, NOISE_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two word sets; 0 if either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of the shares of either word set that the other holds; 0 if nothing is shared."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, 2.0 * shared / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def requested_year(text: Column) -> Column:
    """The first year 1900-2099 that stands alone, null if none."""
    return F.nullif(F.regexp_extract(text, NAMED_YEAR, 1), F.lit(""))


def squeezed(text: Column) -> Column:
    """White space of any kind, no-break spaces included, made single blanks; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def text_key(text: Column) -> Column:
    """Content key of a text, blind to spacing: 32 hex digits."""
    return _short_hash(squeezed(text))


def pair_key(query: Column, document: Column) -> Column:
    return _short_hash(F.concat(squeezed(query), F.char(F.lit(0)), squeezed(document)))


def prompt_key(model: Column, system: Column, prompt: Column) -> Column:
    return _short_hash(F.concat(model, F.char(F.lit(0)), system, F.char(F.lit(0)), squeezed(prompt)))


def normal_cik(cik: Column) -> Column:
    """A registrant number as ten digits; null where it isn't one or is zero."""
    digits = F.regexp_replace(F.regexp_replace(F.upper(F.trim(cik)), "^CIK", ""), "^0+", "")
    return F.when(digits.rlike("^[0-9]{1,10}$"), F.lpad(digits, 10, "0"))


def archive_path(cik: Column, accession: Column, document: Column) -> Column:
    """edgar/data/<number>/<accession without dashes>/<document>."""
    return F.concat_ws("/", F.lit("edgar/data"), F.regexp_replace(cik, "^0+", ""), F.replace(accession, F.lit("-"), F.lit("")), document)


def item_list(items: Column) -> Column:
    """Parts of a comma list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(items, ","), lambda x: F.trim(x)), lambda x: x != "")


def citation(table_id: Column, row_label: Column, column: Column) -> Column:
    """table['row', 'column']; quotes inside labels stay as they are."""
    return F.concat(table_id, F.lit("['"), row_label, F.lit("', '"), column, F.lit("']"))


def excerpts(chunks: Column) -> Column:
    """[id] text of every struct (id, text) of an array, blank lines between."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["id"].cast("string"), F.lit("] "), c["text"])), "\n\n")


def no_answer(text: Column) -> Column:
    """Whether a model's answer is blank or says that the evidence is insufficient."""
    return F.upper(F.trim(F.coalesce(text, F.lit("")))).rlike("^(INSUFFICIENT|$)")


#: Cues that route a question.
CROSS_MODAL_CUES = ("consistent with", "reconcile", "contradict", "square with", "compare", "differ from", "versus", "match the")
BELIEF = r"(?i)\b(do|does|did)\s+(management|the\s+company|they|he|she)\s+(believe|think|expect|anticipate|maintain)\b"
WHY = r"(?i)^\s*(why|what\s+drove|what\s+caused)\b"
REPORTED = r"(?i)\b(what|who)\s+(did|does)\b.*\b(say|state|tell|describe|note)\b|\b(say|said)\s+about\b"
QUANTITY = (
    r"(?i)^\s*(how\s+(much|many|large|small|high|low|concentrated|leveraged)|what\s+(proportion|share|percentage|fraction|portion|number|amount)"
    r"|what\s+were\s+total)\b"
)
MEASURES = (
    "revenue", "margin", "rate", "expenditure", "capex", "amount", "balance", "headcount", "employee", "proportion", "guidance", "accrued", "accrual", "income",
    "expense", "cost", "cash", "debt", "backlog", "price", "total", "growth", "per share",
)
FIGURE = r"(?i)[$€£]|\b\d+(\.\d+)?\s*(%|percent|million|billion)\b"


def _holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def route(question: Column) -> Column:
    """numeric, narrative or cross_modal; the first rule that applies decides, narrative failing all."""
    low = F.lower(F.trim(question))
    return (
        F.when(question.rlike(BELIEF) | _holds_any(low, CROSS_MODAL_CUES), "cross_modal")
        .when(question.rlike(WHY) | question.rlike(REPORTED), "narrative")
        .when(question.rlike(QUANTITY), "numeric")
        .when(low.rlike(r"^what\b") & _holds_any(low, MEASURES), "numeric")
        .when(question.rlike(FIGURE), "numeric")
        .otherwise("narrative")
    )


def analysts(route_: Column) -> Column:
    """The analysts that answer a route, in order."""
    table, narrative = F.lit("table_analyst"), F.lit("narrative_analyst")
    return F.when(route_ == "numeric", F.array(table)).when(route_ == "cross_modal", F.array(table, narrative)).otherwise(F.array(narrative))
