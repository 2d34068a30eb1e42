"""Queries over filings' tables: cells in long form, inferred units, carried scales, figures in prose, and questions to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.numbers import FIGURE, SUFFIX_SCALES, UNIT_WORDS, cell_value, extract_numbers, format_figure, numeric_match
from lodestrata.functions.text import FILLER_WORDS, NAMED_YEAR
from lodestrata.operators import html, metrics, tables
from lodestrata.session import spread, table


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return tables.long_cells(table(spark, d, "table_cells"), table(spark, d, "fin_tables"))


def cells_long(spark: SparkSession, d: str) -> DataFrame:
    value = F.round(F.col("value"), 4)
    return _cells(spark, d).select("table_id", "row_idx", "row_label", "col_idx", "column", "raw", "unit", "scale", value.alias("value"))


def numeric_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that state a figure, as text."""
    return _cells(spark, d).filter("value is not null").select("table_id", "row_idx", "col_idx", format_figure(F.round("value", 4)).alias("figure"))


def table_periods(spark: SparkSession, d: str) -> DataFrame:
    return tables.periods(table(spark, d, "fin_tables"))


def row_units(spark: SparkSession, d: str) -> DataFrame:
    """Unit that label and cells of each row suggest, beside the one stated."""
    rows = table(spark, d, "table_cells").filter("not is_header and row_label is not null").groupBy("table_id", "row_idx")
    each = rows.agg(F.min("row_label").alias("label"), F.min("row_unit").alias("stated"), F.sort_array(F.collect_list("raw")).alias("raws"))  # the cells of one printed row
    return each.select("table_id", "row_idx", "stated", tables.inferred_row_unit(F.col("label"), F.col("raws")).alias("inferred"))


def carried_scales(spark: SparkSession, d: str) -> DataFrame:
    """The last scale note at or before each chunk."""
    first = table(spark, d, "chunks").groupBy("document_id", "ordinal").agg(F.min("id").alias("id"), F.min_by("content", "id").alias("text"))
    return tables.carried_scale(first).select("document_id", "ordinal", "scale")


def prose_figures(spark: SparkSession, d: str) -> DataFrame:
    """How many figures a chunk states, the first and the greatest."""
    own = table(spark, d, "chunks").filter("content is not null").select("id", extract_numbers(F.col("content")).alias("x"))
    return own.select("id", F.size("x").alias("figures"), F.round(F.get("x", F.lit(0)), 4).alias("first"), F.round(F.array_max("x"), 4).alias("greatest"))


def neighbour_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether a row's second column repeats its first within half a percent."""
    c = table(spark, d, "table_cells").filter("not is_header").groupBy("table_id", "row_idx")
    both = c.agg(F.min_by("raw", F.when(F.col("col_idx") == 0, F.col("cell_id"))).alias("a"), F.min_by("raw", F.when(F.col("col_idx") == 1, F.col("cell_id"))).alias("b"))
    return both.select("table_id", "row_idx", numeric_match(F.col("a"), F.col("b")).alias("same"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth table cell asked for by its row's label and its column's, within its issuer."""
    cells = table(spark, d, "table_cells").filter("not is_header and cell_id % 50 = 0 and row_label is not null")
    labels = table(spark, d, "fin_tables").select(F.col("id").alias("table_id"), "document_id", "col_labels")
    asked = cells.join(labels, "table_id").withColumn("period", F.try_element_at("col_labels", F.when(F.col("col_idx") >= 0, F.col("col_idx") + 1).otherwise(1)))
    text = F.concat(F.lit("What was "), "row_label", F.lit(" in "), F.coalesce("period", F.lit("the period")), F.lit("?"))
    return asked.select(F.col("cell_id").alias("query_id"), F.col("document_id").alias("scope"), text.alias("text"))


def cell_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions put to the tables of their own filing."""
    cells = _cells(spark, d).withColumnRenamed("document_id", "scope")
    out = tables.answer_questions(_questions(spark, d), cells, scope="scope")
    return out.withColumns({"value": F.round("value", 4), "confidence": F.round("confidence", 6)}).drop("citation")


def answer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return cell_answers(spark, d).groupBy("outcome", "reason").agg(F.count("*").alias("questions"))


def _asked_and_answered(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the cell they were made from as gold; a cell without a value is one that can't be answered."""
    gold = _cells(spark, d).select("table_id", "row_idx", "col_idx", F.col("raw").alias("gold"), F.col("scale").alias("scale_hint"), F.col("value").isNull().alias("not_disclosed"), "column")
    asked = table(spark, d, "table_cells").filter("cell_id % 50 = 0").select(F.col("cell_id").alias("query_id"), "table_id", "row_idx", "col_idx")
    told = cell_answers(spark, d).select("query_id", F.col("value").cast("decimal(38,4)").cast("string").alias("predicted"), "reason")
    return told.join(asked, "query_id").join(gold, ["table_id", "row_idx", "col_idx"])


def answer_report(spark: SparkSession, d: str) -> DataFrame:
    """How many questions get the figure they were made from, and how refusals fare."""
    rows = _asked_and_answered(spark, d)
    # a figure is compared as it is, the gold cell in its scale
    out = metrics.numeric_report(rows.withColumn("gold", F.when(~F.col("not_disclosed"), cell_value(F.col("gold"), F.col("scale_hint")).cast("decimal(38,4)").cast("string"))).withColumn("scale_hint", F.lit(1.0)), {"dated": F.coalesce(F.col("column").rlike(r"(?:19|20)\d{2}"), F.lit(False))})
    return out.withColumn("value", F.round("value", 6))


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Answered questions whose filing's first chunk states figures, none of which is the answer."""
    first = table(spark, d, "chunks").groupBy(F.col("document_id").alias("scope")).agg(F.min_by("content", F.struct("ordinal", "id")).alias("text"))
    asked = _questions(spark, d).select("query_id", "scope")
    told = cell_answers(spark, d).filter("value is not null").select("query_id", "value").join(asked, "query_id").join(first, "scope")
    return tables.contradictions(told).filter("contradiction is not null").select("query_id", "contradiction")


def covering_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows that cover every word of a table's caption, read as a question, per fiftieth table."""
    q = table(spark, d, "fin_tables").filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.regexp_replace("caption", r"[(—-].*$", "").alias("text"))
    rows = table(spark, d, "table_cells").filter("row_label is not null").select("table_id", "row_label")
    captions = table(spark, d, "fin_tables").select(F.col("id").alias("table_id"), F.col("caption").alias("row_label")).filter("row_label is not null")
    return tables.covering_labels(q, rows.unionByName(captions))


def html_cells(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as HTML pages, one a table, and read back."""
    read = html.read_tables(spread(html.table_pages(table(spark, d, "table_cells"), table(spark, d, "fin_tables"))))
    return read


def html_narratives(spark: SparkSession, d: str) -> DataFrame:
    """What those pages say outside of their tables."""
    return html.narrative_texts(spread(html.table_pages(table(spark, d, "table_cells"), table(spark, d, "fin_tables"))))


def html_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of tables that can be read, per filing."""
    pages = spread(html.table_pages(table(spark, d, "table_cells"), table(spark, d, "fin_tables")))
    owner = table(spark, d, "fin_tables").select(F.col("id").alias("doc_id"), "document_id")
    verdicts = html.table_verdicts(pages).join(owner, "doc_id").select(F.col("document_id").alias("doc_id"), "reason")
    return html.extraction_rates(verdicts).withColumn("rate", F.round("rate", 6))


def html_skips(spark: SparkSession, d: str) -> DataFrame:
    """Tables by the reason for which they can't be read; null for those read."""
    pages = spread(html.table_pages(table(spark, d, "table_cells"), table(spark, d, "fin_tables")))
    return html.table_verdicts(pages).groupBy("reason").agg(F.count("*").alias("tables"))


QUERIES = {
    "cells_long": cells_long, "numeric_cells": numeric_cells, "table_periods": table_periods, "row_units": row_units, "carried_scales": carried_scales, "prose_figures": prose_figures,
    "neighbour_matches": neighbour_matches, "cell_answers": cell_answers, "answer_outcomes": answer_outcomes, "html_cells": html_cells, "html_skips": html_skips, "html_narratives": html_narratives, "html_rates": html_rates,
    "answer_report": answer_report, "contradictions": contradictions, "covering_labels": covering_labels,
}

_FIGURE = FIGURE
_SCALES = f"map {{{', '.join(f"'{w}': {f!r}" for w, f in SUFFIX_SCALES.items())}}}"
_UNITS = f"({', '.join(f"'{w}'" for w in ('%', *UNIT_WORDS))})"


def _number(text: str, hint: str = "1.0") -> str:
    part = lambda n: f"regexp_extract({text}, '{_FIGURE}', {n})"
    size = f"(try_cast(replace({part(3)}, ',', '') as double) * case when lower({part(4)}) in {_UNITS} then 1.0 else coalesce(({_SCALES})[lower({part(4)})], {hint}) end)"
    return f"(case when {part(2)} = '-' or ({part(1)} <> '' and {part(5)} <> '') then -{size} else {size} end)"


_LONG = f"""
one as (select * from table_cells where not is_header qualify row_number() over (partition by table_id, row_idx, col_idx order by cell_id) = 1),
lo as (select c.table_id, t.document_id, caption, row_idx, row_label, col_idx, col_labels[case when col_idx >= 0 then col_idx + 1 else 1 end] as "column", raw, coalesce(row_unit, t.unit) as unit,
  coalesce(row_scale, case when row_unit in ('percent','count','ratio','per_share','duration') then 1.0 end, t.scale_hint, 1.0) as scale from one c join fin_tables t on t.id = c.table_id),
lc as (select *, case when trim(raw) not in ('', '-', '--', '—', 'n/a', 'N/A') then {_number('trim(raw)', 'scale')} end as value from lo)"""


def _figure_text(value: str) -> str:
    text = f"regexp_replace(printf('%.6f', {value}), '\\.?0+$', '')"
    return f"(case when {text} in ('', '-') then '0' else {text} end)"


_FILL = f"({', '.join(f"'{w}'" for w in FILLER_WORDS)})"


def _content(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda w: w not in {_FILL}))"


_ANSWERS = f"""with {_LONG},
qs as (select cell_id as query_id, t.document_id as scope, 'What was ' || row_label || ' in ' || coalesce(col_labels[case when col_idx >= 0 then col_idx + 1 else 1 end], 'the period') || '?' as text
  from table_cells c join fin_tables t on t.id = c.table_id where not is_header and cell_id % 50 = 0 and row_label is not null),
q as (select query_id, scope, {_content('text')} as qw, nullif(regexp_extract(text, '{NAMED_YEAR}', 1), '') as year from qs),
rw as (select document_id as scope, table_id, row_idx, first(row_label order by col_idx) as row_label, first(caption order by col_idx) as caption, list({{'i': col_idx, 'c': "column", 'r': raw, 'u': unit, 'v': value}} order by col_idx) as cols from lc group by 1, 2, 3),
rr as (select *, {_content('row_label')} as lw, {_content("concat_ws(' ', row_label, caption, list_aggregate(list_transform(cols, lambda x: coalesce(x.c, '')), 'string_agg', ' '))")} as known from rw),
se as (select query_id, rr.*, year, qw, case when year is null then cols[1] else list_filter(cols, lambda x: contains(x.c, year))[1] end as cell,
  2.0 * len(list_intersect(qw, lw)) / (len(qw) + len(lw)) as f1, len(list_filter(qw, lambda w: not list_contains(known, w))) as extra
  from q join rr using (scope) where len(list_intersect(qw, lw)) > 0),
sc as (select *, f1 - 0.1 * extra as conf from se),
be as (select * from sc where cell is not null qualify row_number() over (partition by query_id order by round(conf, 9) desc, table_id, row_idx) = 1),
mi as (select query_id, row_label as miss from sc where cell is null and f1 >= 0.4 qualify row_number() over (partition by query_id order by table_id desc, row_idx desc) = 1),
re as (select q.query_id, be.table_id, be.row_label, be.cell, conf, miss, case when miss is not null and (conf is null or round(conf, 9) < 0.4) then 'no column for the requested period'
  when conf is null then 'no row matched the question' when round(conf, 9) < 0.4 then 'row match below confidence floor' when cell.v is null then 'matched cell is empty' end as reason
  from q left join be using (query_id) left join mi using (query_id)),
an as (select query_id, case when reason is null then 'answer' else 'declined' end as outcome, reason, case when reason is null then table_id end as table_id,
  case when reason = 'no column for the requested period' then miss else row_label end as row_label, case when reason is null then cell.c end as "column", case when reason is null then cell.r end as raw,
  case when reason is null then cell.u end as unit, case when reason is null then round(cell.v, 4) end as value, round(conf, 6) as confidence from re)"""

_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NOTE = r"(?i)\(?\s*(?:dollars|amounts|shares)?\s*in\s+(thousands|millions|billions)|(thousands|millions|billions)\s+of\s+(?:dollars|shares|units)"


def _squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACE}', ' ', 'g'))"


def _scale(text: str) -> str:
    word = f"lower(regexp_extract({text}, '{_NOTE}', 1) || regexp_extract({text}, '{_NOTE}', 2))"
    return f"(case {word} when 'thousands' then 1e3 when 'millions' then 1e6 when 'billions' then 1e9 end)"


_HINT = "case scale_hint when 1e3 then ' (in thousands)' when 1e6 then ' (in millions)' when 1e9 then ' (in billions)' else '' end"
#: What the pages of tables say in their text: tables whose id leaves 1 when divided by 4 have their title inside.
_PROSE = f"case when id % 4 = 1 then '' else {_squeezed(f"coalesce(caption, '') || {_HINT}")} end"
_ROW_UNIT = r"""case when contains(gt, '%') then 'percent' when regexp_matches(gt, '(?i)\d\s*(?:year|month|day|week)s?\b') then 'duration' when regexp_matches(label, '(?i)per\s+(?:common\s+)?share|per\s+diluted') then 'per_share'
  when regexp_matches(label, '(?i)%|percent|\brate\b|\bmargin\b') and not regexp_matches(label, '(?i)^\W*(?:amount|total|balance|value|cost|expense|income|profit|loss|benefit|revenue|sales|net|cash|debt|provision|liabilit|asset)') then 'percent'
  when regexp_matches(label, '(?i)employees|headcount|number of|shares outstanding') then 'count' end"""
# the tables as their pages print them: title row, blanks and lone currency signs dropped, header of years
_HTML = rf"""with one as (select * from table_cells qualify row_number() over (partition by table_id, row_idx, col_idx order by cell_id) = 1),
ti as (select id as table_id, id % 4 = 1 as inside, id % 4 as kind, {_squeezed(f"coalesce(caption, '') || {_HINT}")} as head from fin_tables),
r0 as (select o.table_id, row_idx, {_squeezed("coalesce(min(row_label), '')")} as lab, list({_squeezed("coalesce(raw, '')")} order by col_idx) as raws from one o join ti using (table_id) group by 1, 2),
r1 as (select table_id, row_number() over (partition by table_id order by row_idx) - 1 + inside::int as row_no, list_filter(list_concat([lab], raws), lambda x: x not in ('', '$', '€', '£')) as vals from r0 join ti using (table_id)
  union all select table_id, 0, list_filter([head], lambda x: x <> '') from ti where inside and table_id in (select table_id from r0)),
r2 as (select *, count(*) over (partition by table_id) as n, list_filter(vals, lambda v: regexp_full_match(replace(v, ' ', ''), '(?:FY)?(?:19|20)\d{{2}}')) as years from r1),
r3 as (select *, max(case when len(years) >= 2 and len(list_distinct(years)) = len(years) and row_no < 10 then row_no end) over (partition by table_id) as header from r2 where len(vals) > 0),
r4 as (select *, first(years order by (row_no <> header)::int, row_no) over (partition by table_id) as cols,
  bool_or(coalesce(row_no < header and row_no >= header - 2 and len(list_filter(vals, lambda v: not regexp_matches(v, '(?:19|20)\d{{2}}') and {_scale('v')} is null and length(v) > 2)) >= 2, false)) over (partition by table_id) as stacked from r3),
r5 as (select *, vals[1] as label, vals[2:] as given, coalesce(row_no > header and len(vals) > 1, false) as body, coalesce(row_no > header and len(vals) > 1 and len(vals) - 1 = len(cols), false) as kept from r4),
ve as (select table_id, max(n) as n, max(header) as header, bool_or(stacked) as stacked, count(*) filter (kept) as kept, count(*) filter (body and not kept) as ragged, count(distinct label) filter (kept) as labels from r5 group by 1),
hr as (select table_id, case when n < 3 or n is null then 'too few rows' when header is null then 'no year header' when stacked then 'stacked header' when kept = 0 then 'no aligned rows' when ragged > kept then 'mostly ragged' when labels < kept then 'duplicate row labels' end as reason
  from (select distinct table_id from r1) left join ve using (table_id)),
ow as (select table_id, string_agg(array_to_string(vals0, ' '), ' ' order by row_no) as own, string_agg(vals[1], ' | ' order by row_no) filter (len(vals) = 1 and row_no < header) as titles from (select *, vals as vals0 from r3) group by 1),
cp as (select table_id, array_to_string(list_filter([titles, case when kind = 3 then head end], lambda x: coalesce(x, '') <> ''), ' | ') as caption, own || case when kind = 2 and table_id in (select table_id from one where not is_header) then ' $' else '' end as own, head, inside from ow join ti using (table_id)),
cs as (select table_id, coalesce({_scale('own')}, {_scale('caption')}) as said, case when not inside then {_scale('head')} end as running, caption, case when regexp_matches(own || caption, '(?i)dollar|[$]') then 'USD' else 'unknown' end as unit from cp),
ru as (select table_id, row_no, label, given, cols, array_to_string(given, ' ') as gt from r5 join hr using (table_id) where reason is null and kept),
rs as (select *, {_ROW_UNIT} as row_unit, case lower(regexp_extract(label, '(?i)\(\s*in\s+(thousands|millions|billions)\s*\)', 1)) when 'thousands' then 1e3 when 'millions' then 1e6 when 'billions' then 1e9 end as stated from ru),
rt as (select *, coalesce(stated, case when row_unit in ('percent', 'count', 'ratio', 'per_share', 'duration') then arg_min(stated, row_no) filter (stated is not null) over (partition by table_id, row_unit) end) as row_scale from rs),
he as (select rt.table_id as doc_id, 0 as table_no, rt.table_id || '-t0' as table_id, substr(caption || case when said is null and running is not null then ' [scale inherited from section]' else '' end, 1, 200) as caption, unit, coalesce(said, running, 1.0) as scale, said is null and running is not null as inherited,
  row_no::int as row_no, label, row_unit, row_scale, unnest(range(len(given)))::int as col_idx, cols, given from rt join cs on cs.table_id = rt.table_id),
hf as (select doc_id, table_no, table_id, caption, unit, scale, inherited, row_no, label, row_unit, row_scale, col_idx, cols[col_idx + 1] as "column", given[col_idx + 1] as raw, coalesce(row_scale, case when row_unit in ('percent', 'count', 'ratio', 'per_share', 'duration') then 1.0 end, scale) as es from he),
hc as (select * exclude (es), case when trim(raw) not in ('', '-', '--', '—', 'n/a', 'N/A') then {_number('trim(raw)', 'es')} end as value from hf)"""

SQL = {
    "cells_long": f'with {_LONG} select table_id, row_idx, row_label, col_idx, "column", raw, unit, scale, round(value, 4) as value from lc',
    "numeric_cells": f"""with {_LONG}, v as (select *, round(value, 4) as v from lc where value is not null)
select table_id, row_idx, col_idx, case when regexp_replace(printf('%.6f', v), '\\.?0+$', '') in ('', '-') then '0' else regexp_replace(printf('%.6f', v), '\\.?0+$', '') end as figure from v""",
    "table_periods": "select distinct period from (select unnest(col_labels) as period from fin_tables) where period is not null",
    "row_units": r"""
with r as (select table_id, row_idx, min(row_label) as label, min(row_unit) as stated, string_agg(raw, ' ' order by raw) as vals from table_cells where not is_header and row_label is not null group by 1, 2)
select table_id, row_idx, stated, case when contains(vals, '%') then 'percent' when regexp_matches(vals, '(?i)\d\s*(?:year|month|day|week)s?\b') then 'duration'
  when regexp_matches(label, '(?i)per\s+(?:common\s+)?share|per\s+diluted') then 'per_share'
  when regexp_matches(label, '(?i)%|percent|\brate\b|\bmargin\b') and not regexp_matches(label, '(?i)^\W*(?:amount|total|balance|value|cost|expense|income|profit|loss|benefit|revenue|sales|net|cash|debt|provision|liabilit|asset)') then 'percent'
  when regexp_matches(label, '(?i)employees|headcount|number of|shares outstanding') then 'count' end as inferred from r""",
    "carried_scales": r"""
with c as (select * from chunks qualify row_number() over (partition by document_id, ordinal order by id) = 1),
n as (select document_id, ordinal, lower(regexp_extract(content, p, 1) || regexp_extract(content, p, 2)) as w from c,
  (select '(?i)\(?\s*(?:dollars|amounts|shares)?\s*in\s+(thousands|millions|billions)|(thousands|millions|billions)\s+of\s+(?:dollars|shares|units)' as p)),
s as (select document_id, ordinal, case w when 'thousands' then 1e3 when 'millions' then 1e6 when 'billions' then 1e9 end as own from n)
select document_id, ordinal, last_value(own ignore nulls) over (partition by document_id order by ordinal rows unbounded preceding) as scale from s""",
    "prose_figures": f"""
with x as (select id, list_transform(regexp_extract_all(content, '{_FIGURE}'), lambda f: {_number('f')}) as x from chunks where content is not null)
select id, len(x)::int as figures, round(x[1], 4) as first, round(list_max(x), 4) as greatest from x""",
    "neighbour_matches": f"""
with r as (select table_id, row_idx, first(raw order by cell_id) filter (col_idx = 0) as a, first(raw order by cell_id) filter (col_idx = 1) as b from table_cells where not is_header group by 1, 2),
n as (select table_id, row_idx, {_number('a')} as x, {_number('b')} as y from r)
select table_id, row_idx, coalesce(abs(x - y) <= 0.005 * abs(y), false) as same from n""",
    "cell_answers": f'{_ANSWERS} select query_id, outcome, reason, table_id, row_label, "column", raw, unit, value, confidence from an',
    "answer_report": f"""{_ANSWERS},
gr as (select an.query_id, an.value, lo.raw, case when lc.value is not null then round(lc.value, 4) end as gold, coalesce(regexp_matches(lc."column", '(?:19|20)\\d{{2}}'), false) as dated
  from an join table_cells c on c.cell_id = an.query_id join lc on lc.table_id = c.table_id and lc.row_idx = c.row_idx and lc.col_idx = c.col_idx join lo on lo.table_id = c.table_id and lo.row_idx = c.row_idx and lo.col_idx = c.col_idx),
gs as (select *, coalesce(abs(value - gold) <= 0.005 * abs(gold), false)::int as hit, gold is not null as open, value is null as refused from gr),
gt as (select count(*) filter (refused and not open) as tp, count(*) filter (refused and open) as fp, count(*) filter (not refused and not open) as fn, coalesce(avg(hit) filter (open), 0) as em, count(*) filter (open) as n, avg(hit) filter (open and dated) as dm, count(*) as every from gs),
gu as (select unnest([{{'m': 'exact_match', 'v': em}}, {{'m': 'answerable_n', 'v': n}}, {{'m': 'coverage_gap', 'v': case when every > 0 then 0.0 end}}, {{'m': 'exact_match.dated', 'v': dm}},
  {{'m': 'refusal_precision', 'v': case when tp + fp > 0 then tp / (tp + fp) else 0 end}}, {{'m': 'refusal_recall', 'v': case when tp + fn > 0 then tp / (tp + fn) else 0 end}},
  {{'m': 'refusal_f1', 'v': case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end}}, {{'m': 'refusal_support', 'v': tp + fn}}]) as x from gt)
select x.m as metric, round(x.v::double, 6) as value from gu where x.v is not null""",
    "contradictions": f"""{_ANSWERS},
fc as (select document_id, arg_min(content, struct_pack(a := ordinal, b := id)) as text from chunks group by 1),
ct as (select an.query_id, an.value, list_transform(regexp_extract_all(fc.text, '{_FIGURE}'), lambda f: {_number('f')}) as x from an join qs using (query_id) join fc on fc.document_id = qs.scope where an.value is not null and fc.text is not null),
cu as (select *, {_figure_text('value')} as own, list_transform(x[1:3], lambda v: {_figure_text('v')}) as said from ct where len(x) > 0 and len(list_filter(x, lambda v: abs(v - value) <= 0.005 * abs(value))) = 0)
select query_id, 'table cell resolves to ' || own || '; narrative states ' || array_to_string(said, ', ') as contradiction from cu""",
    "covering_labels": f"""
with q as (select id as query_id, list_filter({_content("regexp_replace(caption, '[(—-].*$', '')")}, lambda w: not regexp_full_match(w, '[0-9]+')) as w from fin_tables where id % 50 = 0),
r as (select distinct table_id, row_label from (select table_id, row_label from table_cells union all select id, caption from fin_tables) where row_label is not null),
l as (select *, {_content('row_label')} as w from r)
select query_id, table_id, row_label from q join l on len(q.w) > 0 and len(list_intersect(q.w, l.w)) = len(q.w)""",
    "html_narratives": rf"""
select id as doc_id, {_PROSE} as text from fin_tables where id in (select table_id from table_cells)""",
    "html_cells": f"{_HTML} select * from hc",
    "html_skips": f"{_HTML} select reason, count(*) as tables from hr group by 1",
    "html_rates": f"{_HTML} select document_id as doc_id, count(*) as tables, round(avg((reason is null)::int), 6) as rate from hr join fin_tables t on t.id = hr.table_id group by 1",
    "answer_outcomes": f"{_ANSWERS} select outcome, reason, count(*) as questions from an group by 1, 2",
}
