"""Tables in HTML pages: a small parser lists cells with their place in the grid, everything after it is DataFrame work.

Header rows, titles, the values a row states, units and scales, and the reasons for which a table can't be read are columns and windows
over the cells, one table being the largest group. A scale runs on through a document until another is stated.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.numbers import UNSCALED, cell_value, effective_scale
from lodestrata.functions.text import squeezed
from lodestrata.operators.tables import ROW_SCALE, inferred_row_unit, scale_note, scale_of
from lodestrata.session import cut

#: A column's year, a printed figure, and why a table can't be read.
YEAR = r"^(?:FY)?(?:19|20)\d{2}$"
FIGURE = r"^\(?\s*[$]?\s*[\d,]+(?:\.\d+)?\s*\)?%?$"
REASONS = ("too few rows", "no year header", "stacked header", "no aligned rows", "mostly ragged", "duplicate row labels")
#: Letters of a caption and of a preview, siblings that a caption is made of, and what tells that a scale was inherited.
CAPTION, PREVIEW, SIBLINGS = 200, 80, 3
INHERITED = " [scale inherited from section]"
PLACE = ["doc_id", "table_no"]
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end when one of the named begins inside them.
_ENDS = {"p": frozenset("p div table ul ol h1 h2 h3 h4 h5 h6 section".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Cells(HTMLParser):
    """(table, row, column, text) of every cell, spans counted; rows, caption and preview of every table; text outside of tables apart.

    A table's caption is what its nearest preceding siblings say, SIBLINGS at most. Text right behind a table belongs to it and is passed over.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, list[str]]] = []
        self.prose: list[tuple[int, str]] = []
        self.tables: list[list] = []  # rows, caption, preview
        self.row = -1
        self.depth = self.mute = 0
        self.spans: list[tuple[int, int, int]] = []  # last row, first and last column
        self.column = 0
        self.open: list[str] | None = None
        self.tail = False
        # open elements: tag, text so far, texts of the last children
        self.stack: list[tuple[str, list[str], list[str]]] = [("", [], [])]

    def _push(self, tag: str) -> None:
        while len(self.stack) > 1 and tag in _ENDS.get(self.stack[-1][0], ()) and not (tag == "table" and self.stack[-1][0] in ("td", "th")):
            self._pop()
        self.stack.append((tag, [], []))

    def _pop(self) -> None:
        _, words, _ = self.stack.pop()
        text = _squeeze(" ".join(words))[:CAPTION]
        above = self.stack[-1]
        if text:
            above[2].append(text)
            del above[2][:-SIBLINGS]
            if sum(map(len, above[1])) < 2 * CAPTION:
                above[1].append(text)

    def handle_starttag(self, tag, attrs):
        self.tail = False
        if tag in ("script", "style"):
            self.mute += 1
        if tag in _VOID:
            return
        self._push(tag)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([0, " | ".join(self.stack[-2][2]), []])
                self.row, self.spans, self.open = -1, [], None
        elif tag == "tr" and self.depth:
            self.row, self.column, self.open = self.row + 1, 0, None
            self.spans = [x for x in self.spans if x[0] >= self.row]
        elif tag in ("td", "th") and self.depth and self.row >= 0:
            span = {k: int(v) if (v or "").strip().isdecimal() and int(v) > 0 else 1 for k, v in attrs if k in ("colspan", "rowspan")}
            moved = True
            while moved:
                moved = False
                for _, first, last in self.spans:
                    if first <= self.column <= last:
                        self.column, moved = last + 1, True
            wide, high = span.get("colspan", 1), span.get("rowspan", 1)
            self.tables[-1][0] = max(self.tables[-1][0], self.row + high)
            if high > 1:
                self.spans.append((self.row + high - 1, self.column, self.column + wide - 1))
            self.open = []
            self.cells.append((len(self.tables) - 1, self.row, self.column, self.open))
            self.column += wide

    def handle_endtag(self, tag):
        self.tail = False
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        if tag in ("td", "th"):
            self.open = None
        elif tag == "table" and self.depth:
            self.depth, self.open = self.depth - 1, None
            self.tail = self.depth == 0
        if any(t == tag for t, _, _ in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if self.mute or self.tail:
            return
        if self.depth:
            if sum(map(len, self.tables[-1][2])) < 2 * PREVIEW:
                self.tables[-1][2].append(data)
        elif data.strip():
            self.prose.append((len(self.tables) - 1, data))
        if self.open is not None:
            self.open.append(data)
        if sum(map(len, self.stack[-1][1])) < 2 * CAPTION:
            self.stack[-1][1].append(data)


def page_cells(pages: DataFrame) -> DataFrame:
    """doc_id, table_no (from 0), row_no, col_no, text, rows of every cell. pages (doc_id, html as text or bytes).

    Text between tables has null row_no and counts to the table before it (-1 before any), in the order of col_no. Every table has one
    more row, whose row_no is -1, with the number of its grid rows, blank ones too, its caption as text and a preview. Bytes are read as UTF-8,
    whatever the page declares. Null pages give no rows; broken markup is read as far as it goes.
    """

    def parse(batches):
        for pdf in batches:
            rows = []
            for doc, page in pdf.itertuples(index=False, name=None):
                reader = _Cells()
                reader.feed(page.decode("utf-8", "replace") if isinstance(page, bytes | bytearray) else page)
                reader.close()
                rows += [(doc, t, r, c, " ".join(x), None, None) for t, r, c, x in reader.cells]
                rows += [(doc, t, None, k, x, None, None) for k, (t, x) in enumerate(reader.prose)]
                rows += [(doc, t, -1, -1, caption, n, _squeeze(" ".join(x))[:PREVIEW]) for t, (n, caption, x) in enumerate(reader.tables)]
                if len(rows) > 50_000:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    def frame(rows):
        return pd.DataFrame(rows, columns=["doc_id", "table_no", "row_no", "col_no", "text", "rows", "preview"]).astype({"row_no": "Int32", "rows": "Int32", "preview": object})

    kind = pages.schema["doc_id"].dataType.simpleString()
    cells = pages.select("doc_id", "html").filter("html is not null").mapInPandas(parse, f"doc_id {kind}, table_no int, row_no int, col_no int, text string, rows int, preview string")
    return cells.withColumn("text", squeezed(F.col("text")))


def narrative_texts(pages: DataFrame) -> DataFrame:
    """doc_id, text: what a page says outside of tables, scripts and styles, one line per stretch of text; pages that say nothing give ''."""
    lines = page_cells(pages).filter("row_no is null and text <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("col_no", "text"))).alias("x"))  # one page
    text = F.array_join(F.transform("x", lambda r: r["text"]), "\n")
    return pages.filter("html is not null").select("doc_id").join(lines, "doc_id", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("text"))


def stated_values(cells: Column) -> Column:
    """The values that a row's cells state: blanks and lone currency signs dropped, split brackets and percent signs put back."""
    start = F.struct(F.array().cast("array<string>").alias("vals"), F.lit("").alias("lead"))

    def step(acc: Column, x: Column) -> Column:
        tail = F.when(F.size(acc["vals"]) > 0, F.concat(F.slice(acc["vals"], 1, F.size(acc["vals"]) - 1), F.array(F.concat(F.element_at(acc["vals"], -1), x)))).otherwise(acc["vals"])
        return (
            F.when(x.isin("", "$", "€", "£"), acc)
            .when(x.isin("(", "$("), F.struct(acc["vals"].alias("vals"), F.lit("(").alias("lead")))
            .when(x.isin(")", ")%", "%"), F.struct(tail.alias("vals"), acc["lead"].alias("lead")))
            .otherwise(F.struct(F.concat(acc["vals"], F.array(F.concat(acc["lead"], x))).alias("vals"), F.lit("").alias("lead")))
        )

    return F.aggregate(cells, start, step, lambda acc: acc["vals"])


def _rows(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, label, vals, header_row (the last of the first ten rows that names two or more distinct years), of
    the rows of `page_cells` that state something; rows counts all of a table's."""
    kept = cells.filter("row_no is not null")
    rows = kept.groupBy("doc_id", "table_no", "row_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]).alias("cells"), F.max("rows").alias("rows"))
    whole = Window.partitionBy("doc_id", "table_no")
    rows = rows.withColumn("rows", F.max("rows").over(whole)).withColumn("caption", F.max(F.when(F.col("row_no") < 0, F.col("cells")[0])).over(whole))
    rows = rows.filter("row_no >= 0").withColumn("vals", stated_values(F.col("cells"))).filter(F.size("vals") > 0)
    years = F.filter("vals", lambda v: F.replace(v, F.lit(" "), F.lit("")).rlike(YEAR))
    names = (F.size(years) >= 2) & (F.size(F.array_distinct(years)) == F.size(years)) & (F.col("row_no") < 10)
    rows = rows.withColumn("header_row", F.max(F.when(names, F.col("row_no"))).over(whole)).withColumn("columns", F.max(F.when(F.col("row_no") == F.col("header_row"), years)).over(whole))
    words = F.filter("vals", lambda v: ~v.rlike(r"\b(?:19|20)\d{2}\b") & scale_note(v).isNull() & (F.length(v) > 2))
    above = (F.col("row_no") < F.col("header_row")) & (F.col("row_no") >= F.col("header_row") - 2) & (F.size(words) >= 2)
    rows = rows.withColumn("stacked", F.max(F.coalesce(above, F.lit(False))).over(whole))
    return rows.withColumn("label", F.col("vals")[0]).withColumn("given", F.slice("vals", 2, F.greatest(F.size("vals"), F.lit(1))))


def banded_rows(rows: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, top (the row of names), label, col_idx, column, raw of tables whose years are bands of rows under a header of other names.

    Every (row, name) becomes a row of its own, 'row -- name', with one column per band. There must be two bands or more, all of other
    years; rows as wide as most are read, those that a band lacks are left out, and a label twice in a band bars the whole table.
    """
    whole = Window.partitionBy(*PLACE)
    down = whole.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    odd = F.exists("vals", lambda v: v.rlike(r"\b(?:19|20)\d{2}\b") | v.rlike(FIGURE))
    naming = (F.size("vals") >= 3) & ~odd & (F.size(F.array_distinct("vals")) == F.size("vals")) & (F.col("row_no") < 12)
    r = rows.filter("header_row is null and rows >= 3").withColumn("top", F.min(F.when(naming, F.col("row_no"))).over(whole)).filter("top is not null")
    r = r.withColumn("names", F.max(F.when(F.col("row_no") == F.col("top"), F.col("vals"))).over(whole))
    alone = (F.col("row_no") > F.col("top")) & (F.size("vals") == 1) & F.col("vals")[0].rlike(r"^(?:19|20)\d{2}$")
    r = r.withColumn("mark", F.when(alone, F.col("vals")[0])).withColumn("column", F.last("mark", ignorenulls=True).over(down)).withColumn("band", F.count("mark").over(down))
    marks = r.groupBy(*PLACE).agg(F.count("mark").alias("bands"), F.size(F.collect_set("mark")).alias("years"))
    body = r.filter(F.col("column").isNotNull() & (F.size("vals") > 1)).withColumn("w", F.size("given"))
    usual = body.groupBy(*PLACE, "w").agg(F.count("*").alias("n"), F.min("row_no").alias("first")).groupBy(*PLACE).agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("width"))
    body = body.join(marks.filter("bands > 1 and bands = years"), PLACE).join(usual, PLACE).filter("w = width and size(names) in (width, width + 1)")
    body = body.withColumn("names", F.slice("names", F.size("names") - F.col("width") + 1, F.col("width")))
    body = body.withColumn("twice", F.count("*").over(Window.partitionBy(*PLACE, "label", "band")) > 1).withColumn("barred", F.max("twice").over(whole)).filter("not barred")
    body = body.withColumn("in_bands", F.count("*").over(Window.partitionBy(*PLACE, "label"))).filter("in_bands = bands")
    each = body.select(*PLACE, "row_no", "top", "label", (F.col("band") - 1).cast("int").alias("col_idx"), "column", F.explode(F.arrays_zip("names", F.col("given").alias("raw"))).alias("x"))
    return each.select(*PLACE, "row_no", "top", F.concat_ws(" -- ", "label", "x.names").alias("label"), "col_idx", "column", "x.raw")


def table_verdicts(pages: DataFrame) -> DataFrame:
    """doc_id, table_no, reason, preview: null reason for a table that can be read, else the first that applies. Tables without any
    row that states something have too few."""
    cells = cut(page_cells(pages))
    every = cells.filter("row_no = -1").select(*PLACE, "preview")
    said = _verdicts(_rows(cells)).withColumn("known", F.lit(True))
    return every.join(said, PLACE, "left").select(*PLACE, F.when(F.col("known"), F.col("reason")).otherwise(REASONS[0]).alias("reason"), "preview")


def extraction_rates(verdicts: DataFrame) -> DataFrame:
    """doc_id, tables, rate: the share of each document's tables that could be read. Documents without tables have no row, and a rate of 0."""
    return verdicts.groupBy("doc_id").agg(F.count("*").alias("tables"), F.avg(F.col("reason").isNull().cast("double")).alias("rate"))


def _verdicts(rows: DataFrame) -> DataFrame:
    body = (F.col("row_no") > F.col("header_row")) & (F.size("vals") > 1)
    aligned = body & (F.size("given") == F.size("columns"))
    banded = banded_rows(rows).select(*PLACE, F.lit(True).alias("banded")).distinct()
    each = rows.groupBy(*PLACE).agg(
        F.max("rows").alias("rows"), F.max("header_row").alias("header"), F.max("stacked").alias("stacked"), F.count_if(aligned).alias("kept"), F.count_if(body & ~aligned).alias("ragged"),
        F.size(F.collect_set(F.when(aligned, F.col("label")))).alias("labels"),
    )
    each = each.join(banded, PLACE, "left")
    tests = (F.col("rows") < 3, F.col("header").isNull(), F.col("stacked"), F.col("kept") == 0, F.col("ragged") > F.col("kept"), F.col("labels") < F.col("kept"))
    reason = F.when(F.col("banded"), None)
    for test, name in zip(tests, REASONS, strict=True):
        reason = reason.when(test, name)
    return each.select(*PLACE, reason.cast("string").alias("reason"))


def _running_scales(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, running: the last scale stated before each table, in text or in the cells of earlier tables."""
    notes = cells.filter("row_no is null or row_no >= 0").withColumn("note", scale_note(F.col("text"))).filter("note is not null")
    # text behind table n comes after its cells, and both before table n + 1
    place = F.struct(F.col("row_no").isNull().cast("int").alias("side"), F.coalesce("row_no", F.lit(0)).alias("row"), F.col("col_no").alias("at"))
    last = notes.groupBy(*PLACE).agg(F.max_by("note", place).alias("last"))
    known = cells.filter("row_no = -1").select(*PLACE).unionByName(last.select(*PLACE)).distinct().join(last, PLACE, "left")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, -1))
    return known.select(*PLACE, before.alias("running"))


def read_tables(pages: DataFrame) -> DataFrame:
    """doc_id, table_no, table_id, caption, unit, scale, inherited, row_no, label, row_unit, row_scale, col_idx, column, raw, value of the
    readable tables' aligned rows.

    The caption is made of the single-value rows above the header and the table's preceding siblings. scale is what the table says, else its
    caption, else the last note before it in the document (inherited), else 1; unit is USD where table or caption speak of dollars, else
    unknown. A scale in a row's label holds for the row, and for rows without one that share its unit if that takes no scale from the table. value
    is null for nil marks.
    """
    cells = cut(page_cells(pages))
    every = cut(_rows(cells))
    rows = every.join(_verdicts(every).filter("reason is null").select(*PLACE), PLACE)
    rows = rows.filter((F.col("row_no") > F.col("header_row")) & (F.size("given") == F.size("columns")))
    rows = rows.select(*PLACE, "row_no", "header_row", "label", F.posexplode("given").alias("col_idx", "raw"), "columns", inferred_row_unit(F.col("label"), F.col("given")).alias("row_unit"))
    rows = rows.select(*PLACE, "row_no", F.col("header_row").alias("top"), "label", "col_idx", F.col("columns")[F.col("col_idx")].alias("column"), "raw", "row_unit")
    banded = banded_rows(every)
    told = banded.groupBy(*PLACE, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "raw"))), lambda x: x["raw"]).alias("raws"))
    banded = banded.join(told, [*PLACE, "label"]).withColumn("row_unit", inferred_row_unit(F.col("label"), F.col("raws"))).drop("raws")
    rows = rows.unionByName(banded)
    # row scales, and the units they carry to
    own_scale = scale_of(F.regexp_extract("label", ROW_SCALE, 1))
    whole = Window.partitionBy(*PLACE, "row_unit")
    carried = F.min_by("stated", F.when(F.col("stated").isNotNull(), F.struct("row_no", "label"))).over(whole)
    rows = rows.withColumn("stated", own_scale).withColumn("row_scale", F.coalesce("stated", F.when(F.col("row_unit").isin(*UNSCALED), carried)))
    # title rows, caption and scale of the table
    tops = rows.select(*PLACE, "top").distinct()
    titles = every.filter(F.size("vals") == 1).join(tops, PLACE).filter("row_no < top").groupBy(*PLACE).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "label"))), lambda r: r["label"]).alias("titles"))
    own = cells.filter("row_no >= 0").groupBy(*PLACE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "col_no", "text"))), lambda c: c["text"]), " ").alias("own"))  # one printed table
    about = every.groupBy(*PLACE).agg(F.max("caption").alias("above")).join(own, PLACE).join(tops, PLACE, "left_semi").join(titles, PLACE, "left").join(_running_scales(cells), PLACE, "left")
    caption = F.array_join(F.filter(F.concat(F.coalesce("titles", F.array().cast("array<string>")), F.array(F.coalesce("above", F.lit("")))), lambda x: x != ""), " | ")
    about = about.withColumn("caption", caption).withColumn("said", F.coalesce(scale_note(F.col("own")), scale_note(F.col("caption"))))
    about = about.withColumn("unit", F.when(F.concat("own", "caption").rlike(r"(?i)dollar|[$]"), "USD").otherwise("unknown")).withColumn("inherited", F.col("said").isNull() & F.col("running").isNotNull())
    about = about.select(*PLACE, F.substring(F.concat("caption", F.when(F.col("inherited"), INHERITED).otherwise("")), 1, CAPTION).alias("caption"), "unit", F.coalesce("said", "running", F.lit(1.0)).alias("scale"), "inherited")
    out = rows.join(about, PLACE).withColumn("table_id", F.concat(F.col("doc_id").cast("string"), F.lit("-t"), F.col("table_no").cast("string")))
    value = cell_value(F.col("raw"), effective_scale(F.col("row_scale"), F.col("row_unit"), F.col("scale")))
    return out.select(*PLACE, "table_id", "caption", "unit", "scale", "inherited", "row_no", "label", "row_unit", "row_scale", "col_idx", "column", "raw", value.alias("value"))


def _escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def table_pages(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id (the table's id), html: every table as a page with its caption and scale note.

    Of four tables one has its title in a row of its own across the table, one prints currency signs in columns of their own under headers that
    span both; the note of the others stands in a paragraph, beside the table or before the section that holds it.
    """
    one = cells.groupBy("table_id", "row_idx", "col_idx").agg(F.min(F.struct("cell_id", "row_label", "raw", "is_header")).alias("c")).select("table_id", "row_idx", "col_idx", "c.*")
    kind = F.pmod("table_id", F.lit(4))
    text = _escaped(F.coalesce("raw", F.lit("")))
    spanned = F.when(F.col("is_header"), F.concat(F.lit('<th colspan="2">'), text, F.lit("</th>"))).otherwise(F.concat(F.lit("<td>$</td><td>"), text, F.lit("</td>")))
    td = F.when(kind == 2, spanned).otherwise(F.concat(F.lit("<td>"), text, F.lit("</td>")))
    rows = one.groupBy("table_id", "row_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", td.alias("td")))), lambda c: c["td"]), "").alias("tds"), F.min("row_label").alias("label"))
    rows = rows.withColumn("tr", F.concat(F.lit("<tr><th>"), _escaped(F.coalesce("label", F.lit(""))), F.lit("</th>"), "tds", F.lit("</tr>")))
    body = rows.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "tr"))), lambda r: r["tr"]), "").alias("body"))  # one printed table
    note = F.when(F.col("scale_hint") == 1e3, " (in thousands)").when(F.col("scale_hint") == 1e6, " (in millions)").when(F.col("scale_hint") == 1e9, " (in billions)").otherwise("")
    head = F.concat(_escaped(F.coalesce("caption", F.lit(""))), note)
    inside = F.concat(F.lit('<html><body><table><tr><td colspan="9">'), head, F.lit("</td></tr>"), "body", F.lit("</table></body></html>"))
    before = F.concat(F.lit("<html><body><p>"), head, F.lit("</p><div><table>"), "body", F.lit("</table></div></body></html>"))
    beside = F.concat(F.lit("<html><body><p>"), head, F.lit("</p><table>"), "body", F.lit("</table></body></html>"))
    known = tables.select(F.col("id").alias("table_id"), "caption", "scale_hint")
    return body.join(known, "table_id").select(F.col("table_id").alias("doc_id"), F.when(kind == 1, inside).when(kind == 3, beside).otherwise(before).alias("html"))
