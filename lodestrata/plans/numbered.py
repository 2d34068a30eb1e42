"""Queries of the general problems: common units and proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.encoding import ONE_BYTE, WRONG_READERS
from lodestrata.operators import proximity, units
from lodestrata.plans.triage import metres_sql, points_sql
from lodestrata.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_amounts(spark, d).select("cell_id", "unit", "amount_milli")


def p1_amounts(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "table_cells"), table(spark, d, "fin_tables"), table(spark, d, "filings"))


def p1_by_unit(spark: SparkSession, d: str) -> DataFrame:
    """Figures, those that identities decided, and ambiguous ones per common unit."""
    return p1_amounts(spark, d).groupBy("unit").agg(F.count("*").alias("figures"), F.count_if("solved").alias("solved"), F.count_if(~F.col("unique")).alias("ambiguous"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.near_reports(table(spark, d, "reports"), table(spark, d, "images"), table(spark, d, "segments"))


QUERIES = {"p1_found": p1_found, "p1_amounts": p1_amounts, "p1_by_unit": p1_by_unit, "p7_found": p7_found}

_LINES = r"""
vx as (select id, list_transform(string_split_regex(trim(regexp_extract(regexp_replace(geom, '\s+', ' ', 'g'), '(?i)^\s*(?:srid=\d+;)?\s*linestring\s*(?:zm|z|m)?\s*\(([^()]*)\)', 1)), '\s*,\s*'),
  lambda p: {'x': try_cast(string_split(p, ' ')[1] as double), 'y': try_cast(string_split(p, ' ')[2] as double)}) as v from segments),
vy as (select id, list_filter(v, lambda p: p.x is not null and p.y is not null) as v from vx),
pi as (select id, v[i].x as x1, v[i].y as y1, v[i + 1].x as x2, v[i + 1].y as y2 from (select id, v, unnest(range(1, len(v))) as i from vy where len(v) > 1)),
pc as (select id, x1, y1, x1 + case when x2 - x1 > 180 then x2 - x1 - 360 when x2 - x1 < -180 then x2 - x1 + 360 else x2 - x1 end as x2, y2 from pi)"""
#: Signs that printed figures hold beyond ASCII; their garbled forms are undone one by one, where the operator inverts encodings.
_SIGNS = "−–—·’¢×¹²³  "


def _misread(text: str, reader: str) -> str | None:
    data = text.encode("utf-8")
    out = []
    for b in [data] if reader == "gbk" else [bytes([x]) for x in data]:
        try:
            out.append(b.decode(reader))
        except UnicodeDecodeError:
            if reader != "cp1252":
                return None
            out.append(chr(b[0]))
    return "".join(out)


def _unmisread(text: str) -> str:
    """SQL that puts back every sign that was misread once or twice, the longest forms first."""
    forms = {}
    for sign in _SIGNS:
        once = [w for r in WRONG_READERS if (w := _misread(sign, r))]
        for w in [*once, *(v for x in once for r in WRONG_READERS if (v := _misread(x, r)))]:
            forms.setdefault(w, sign)
    for wrong in sorted(forms, key=lambda w: (-len(w), w)):
        text = f"replace({text}, '{wrong.replace(chr(39), chr(39) * 2)}', '{forms[wrong]}')"
    return text


def _one_byte(text: str, figure: str) -> str:
    """SQL: the first reading with one of the one-byte encodings taken for another that makes a figure, else the text as it is."""
    readings = []
    for wrong in ONE_BYTE:
        for right in ONE_BYTE:
            pairs = {}
            for sign in _SIGNS:
                try:
                    seen = sign.encode(right).decode(wrong)
                except UnicodeError:
                    continue
                if seen != sign and not seen.isascii():
                    pairs[seen] = sign
            if pairs:
                readings.append(f"translate({text}, '{''.join(pairs)}', '{''.join(pairs.values())}')")
    return f"coalesce(list_filter([{text}, {', '.join(readings)}], lambda x: regexp_matches({_plain('x')}, '{figure}'))[1], {text})"


def _plain(text: str) -> str:
    blanks = "".join(f"\\x{{{ord(c):x}}}" for c in units.BLANKS)
    text = f"trim(regexp_replace(translate({text}, '−–', '--'), '[ {blanks}]+', ' ', 'g'))"
    return f"lower(trim(regexp_replace({text}, '{_NOTE_MARK}', '\\1')))"


_NOTE_MARK = r"([\p{L}0-9)%¢×.])(?:\s*(?:\(\d{1,2}\)|\[\w{1,2}\]|\*+|†+|‡+|[¹²³⁰-⁹]+)){1,2}$"
_PRINTED = r"^([-(]?)\s*(?:us\$|usd|\$)?\s*([-(]*)\s*(?:us\$|usd|\$)?\s*(\d{1,3}(?:[ ,''’]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)\s*(?:((?:thousand|million|billion|trillion)s?|bln|bn|mn|mm|tn|k|m)\b)?\s*([^\d()]*?2?)\s*\)?\s*$"
_UNIT_MAP = "map {" + ", ".join(f"'{w}': {{'u': '{u}', 'n': {m.split('/')[0]}::decimal(20,5), 'd': {m.partition('/')[2] or 1}}}" for w, (u, m) in units.UNITS.items()) + "}"
_SCALE_MAP = "map {" + ", ".join(f"'{w}': {f:.0f}::bigint" for w, f in units.SCALES.items()) + "}"


def _scale(text: str) -> str:
    low = f"lower({text})"
    word = rf"coalesce(nullif(regexp_extract({low}, '\b(thousands?|millions?|billions?|trillions?|bln|bn|mn|mm|000)\b', 1), ''), nullif(regexp_extract({low}, '(?:usd |\$ )([km])\b', 1), ''))"
    return f"({_SCALE_MAP})[{word}]"


def _unit(text: str) -> str:
    words = rf"regexp_replace(regexp_replace(lower({text}), '\b(?:thousands?|millions?|billions?|trillions?)(?: of)?\b', '', 'g'), '(usd )(?:k|m|mm|mn|bn|bln)$', '\1')"
    return f"nullif(trim(regexp_replace({words}, '\\s+', ' ', 'g')), '')"


_OWN = "('" + "', '".join(units.OWN_SCALE) + "')"
_WORDS = rf"""ft as (select t.id as table_id, caption, t.unit as tu, t.scale_hint as th, f.scale_hint as fh,
  regexp_extract(lower(caption), '[(\[,—]\s*([^()\[\],—]+?)\s*[)\]]?$', 1) as inner_ from fin_tables t left join filings f on f.id = t.document_id),
tt as (select table_id, fh, coalesce({_unit('tu')}, case when ({_UNIT_MAP})[{_unit("regexp_replace(inner_, '\\s+in\\s+(thousand|million|billion|trillion)', ' \\1')")}] is not null then {_unit("regexp_replace(inner_, '\\s+in\\s+(thousand|million|billion|trillion)', ' \\1')")} end) as tword,
  coalesce({_scale('tu')}, th::bigint, {_scale('caption')}) as tscale from ft),
c0 as (select cell_id, table_id, row_label, row_unit, row_scale, {_unmisread('raw')} as raw from table_cells where not is_header and raw is not null),
c1 as (select *, {_plain(_one_byte('raw', _PRINTED))} as x from c0),
c2 as (select *, regexp_extract(x, '{_PRINTED}', ['lead', 'more', 'num', 'scale', 'rest']) as f from c1 where regexp_matches(x, '{_PRINTED}')),
c3 as (select c2.*, trim(f.rest) as rest, {_unit('row_unit')} as rword, tword, tscale, fh from c2 left join tt using (table_id) where trim(f.rest) = '' or ({_UNIT_MAP})[trim(f.rest)] is not null),
c4 as (select *, nullif(rest, '') as said, ({_SCALE_MAP})[f.scale] as sscale, case when rest in ('c', '¢') and coalesce(({_UNIT_MAP})[rword].u, 'USD_per_share') <> 'USD_per_share' then rword end as hundredths from c3),
c5 as (select *, coalesce(hundredths, said, rword, tword) as w0, trim(lower(regexp_replace(regexp_replace(row_label, '\s*[(,—].*$', ''), '\s+', ' ', 'g'))) as label,
  {_scale("regexp_extract(row_label, '(?i)[(,—-]\\s*(?:in )?(thousands?|millions?|billions?)\\)?\\s*$', 1)")} as lscale from c4),
c6 as (select *, case when w0 is null then null when ({_UNIT_MAP})[w0] is null then 'usd' else w0 end as word from c5),
di as (select label, u, count(*) as n from (select label, ({_UNIT_MAP})[word].u as u from c6 where word is not null and label is not null) group by 1, 2),
dm as (select label, arg_max(u, struct_pack(a := n, b := u)) as u, max(n) >= 0.9 * sum(n) as sure from di group by 1),
c7 as (select c6.*, c6.word is null as solved, coalesce(c6.word, 'usd') as w, c6.word is null and not coalesce(dm.sure, false) as doubtful from c6 left join dm on dm.label = c6.label),
c8 as (select *, ({_UNIT_MAP})[w] as m, coalesce(sscale, case when said is not null then 1 end, row_scale::bigint, lscale, {_scale('row_unit')}, case when ({_UNIT_MAP})[w].u in {_OWN} then 1 end, tscale, fh::bigint, 1) as s from c7),
am as (select cell_id, m.u as unit, (case when f.lead || f.more <> '' then -1 else 1 end) * case when m.d = 1 then round(translate(f.num, ' ,''’', '')::decimal(18,4) * (m.n * s)::decimal(20,5), 0)::bigint else round(translate(f.num, ' ,''’', '')::decimal(18,4)::double * (m.n::double * s) / m.d)::bigint end as amount_milli, not doubtful as "unique", solved from c8)"""
_DEGREE = "(pi() * 6371000 / 180)"
SQL: dict[str, str] = {
    "p1_found": f"with {_WORDS} select cell_id, unit, amount_milli from am",
    "p1_amounts": f"with {_WORDS} select * from am",
    "p1_by_unit": f'with {_WORDS} select unit, count(*) as figures, count(*) filter (solved) as solved, count(*) filter (not "unique") as ambiguous from am group by 1',
    "p7_found": f"""with r as materialized {points_sql('reports')}, im as materialized {points_sql('images')}, {_LINES},
pl as (select r.id as rid, pc.id as sid, (x1 - lon - 360 * round((x1 - lon) / 360)) * cos(radians(lat)) * {_DEGREE} as ax, (y1 - lat) * {_DEGREE} as ay, (x2 - x1) * cos(radians(lat)) * {_DEGREE} as dx, (y2 - y1) * {_DEGREE} as dy
  from r join pc on lat between least(y1, y2) - 0.0006 and greatest(y1, y2) + 0.0006),
pt as (select *, case when dx * dx + dy * dy > 0 then greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) else 0.0 end as t from pl),
on_line as (select rid, sid from pt where round(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)), 6) <= 50
  qualify row_number() over (partition by rid order by round(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)), 6), sid) = 1)
select 'reports' as other_table, a.id as report_id, b.id as other_id from r a join r b on a.id < b.id and b.lat between a.lat - 0.0003 and a.lat + 0.0003 where {metres_sql('a', 'b')} <= 20
union all select 'images', a.id, b.id from r a join im b on b.lat between a.lat - 0.0004 and a.lat + 0.0004 where {metres_sql('a', 'b')} <= 30
union all select 'segments', rid, sid from on_line""",
}
