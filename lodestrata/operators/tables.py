"""Tables in long form and questions to them: cells with their own unit and scale, and the cell that answers a question, or why none.

Questions meet rows by an equi-join on content words, so a question is never held against a table it shares no word with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.numbers import cell_value, effective_scale, extract_numbers, format_figure
from lodestrata.functions.text import citation, question_words, requested_year

#: Confidence below which a row is no answer, and what each unexplained word of the question costs.
FLOOR, PENALTY = 0.40, 0.10
MISSES = ("no column for the requested period", "no row matched the question", "row match below confidence floor", "matched cell is empty")

#: How filings state a scale, and what tells a row's unit.
SCALE_NOTE = r"(?i)\(?\s*(?:dollars|amounts|shares)?\s*in\s+(thousands|millions|billions)|(thousands|millions|billions)\s+of\s+(?:dollars|shares|units)"
ROW_SCALE = r"(?i)\(\s*in\s+(thousands|millions|billions)\s*\)"
PERCENT_LABEL = r"(?i)%|percent|\brate\b|\bmargin\b"
PER_SHARE_LABEL = r"(?i)per\s+(?:common\s+)?share|per\s+diluted"
COUNT_LABEL = r"(?i)employees|headcount|number of|shares outstanding"
DURATION_CELL = r"(?i)\d\s*(?:year|month|day|week)s?\b"
AMOUNT_LABEL = r"(?i)^\W*(?:amount|total|balance|value|cost|expense|income|profit|loss|benefit|revenue|sales|net|cash|debt|provision|liabilit|asset)"


def scale_of(word: Column) -> Column:
    word = F.lower(word)
    return F.when(word == "thousands", 1e3).when(word == "millions", 1e6).when(word == "billions", 1e9)


def scale_note(text: Column) -> Column:
    """The factor of the first scale note of a text, null if there is none."""
    return scale_of(F.concat(F.regexp_extract(text, SCALE_NOTE, 1), F.regexp_extract(text, SCALE_NOTE, 2)))


def inferred_row_unit(label: Column, values: Column) -> Column:
    """percent, duration, per_share, count or null; what the cells print goes before what the label mentions."""
    text = F.array_join(values, " ")
    percent = label.rlike(PERCENT_LABEL) & ~label.rlike(AMOUNT_LABEL)
    return F.when(text.contains("%"), "percent").when(text.rlike(DURATION_CELL), "duration").when(label.rlike(PER_SHARE_LABEL), "per_share").when(percent, "percent").when(label.rlike(COUNT_LABEL), "count")


def long_cells(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, document_id, caption, row_idx, row_label, col_idx, column, raw, unit, scale, value of every body cell.

    Of repeated cells of one place the smallest cell_id counts. Cells of unknown tables are left out; a column without a label
    stays null.
    """
    t = tables.select(F.col("id").alias("table_id"), "document_id", "caption", F.col("scale_hint").alias("_hint"), F.col("unit").alias("_unit"), "col_labels")
    one = cells.filter("not is_header").groupBy("table_id", "row_idx", "col_idx").agg(F.min(F.struct("cell_id", "row_label", "row_unit", "row_scale", "raw")).alias("c")).select("table_id", "row_idx", "col_idx", "c.*")
    out = one.join(t, "table_id").withColumn("unit", F.coalesce("row_unit", "_unit"))
    out = out.withColumn("scale", effective_scale(F.col("row_scale"), F.col("row_unit"), F.col("_hint"))).withColumn("column", F.try_element_at("col_labels", F.when(F.col("col_idx") >= 0, F.col("col_idx") + 1).otherwise(1)))
    return out.select("table_id", "document_id", "caption", "row_idx", "row_label", "col_idx", "column", "raw", "unit", "scale", cell_value(F.col("raw"), F.col("scale")).alias("value"))


def checked_rows(rows: DataFrame) -> DataFrame:
    """table_id, row_idx, label, col_idx, column, raw of fixture tables (id, columns, rows array<struct<label, values>>); a row with
    another number of values than columns raises."""
    each = rows.select(F.col("id").alias("table_id"), "columns", F.posexplode("rows").alias("row_idx", "r"))
    wrong = F.raise_error(F.concat(F.lit("ragged row in table "), F.col("table_id").cast("string")))
    each = each.filter(F.when(F.size("r.values") == F.size("columns"), F.lit(True)).otherwise(wrong.cast("boolean")))
    each = each.select("table_id", "row_idx", F.col("r.label").alias("label"), "columns", F.posexplode("r.values").alias("col_idx", "raw"))
    return each.select("table_id", "row_idx", "label", "col_idx", F.col("columns")[F.col("col_idx")].alias("column"), "raw")


def periods(tables: DataFrame) -> DataFrame:
    """Distinct column labels."""
    return tables.select(F.explode("col_labels").alias("period")).filter("period is not null").distinct()


def answer_questions(questions: DataFrame, cells: DataFrame, scope: str | None = None) -> DataFrame:
    """One row per question: query_id, outcome (answer or declined), reason, table_id, row_label, column, raw, unit, value, confidence,
    citation.

    questions (query_id, text), cells as of `long_cells`. A row's confidence is the F1 of its label's and the question's words less a
    penalty for every word that neither label, caption nor columns explain; the best row answers, ties going to the smaller table and
    row. A named year must appear in a column's label, else the first column is meant. With `scope`, a column of both sides, a
    question is put only to the rows of its own scope.
    """
    within = [scope] if scope else []
    q = questions.select("query_id", *within, question_words(F.col("text")).alias("qw"), requested_year(F.col("text")).alias("year"))
    # one row a table row: its words, and its columns in order
    first = lambda c: F.min_by(c, "col_idx").alias(c)
    rows = cells.groupBy(*within, "table_id", "row_idx").agg(first("row_label"), first("caption"), F.sort_array(F.collect_list(F.struct("col_idx", "column", "raw", "unit", "value"))).alias("cols"))
    names = F.array_join(F.transform("cols", lambda c: F.coalesce(c["column"], F.lit(""))), " ")
    rows = rows.withColumn("lw", question_words(F.col("row_label"))).withColumn("known", F.array_union("lw", question_words(F.concat_ws(" ", "caption", names))))
    place = ["table_id", "row_idx"]
    words = rows.select(*within, *place, F.explode("lw").alias("w"))
    overlap = q.select("query_id", *within, F.explode("qw").alias("w")).join(words, [*within, "w"]).groupBy("query_id", *place).agg(F.count("*").alias("shared"))
    # the label's word count rides along, so that rows too weak to answer or to report a missing period go before anything wide joins
    sized = overlap.join(rows.select(*place, F.size("lw").alias("ln")), place).join(q.select("query_id", F.size("qw").alias("qn"), "qw", "year"), "query_id")
    sized = sized.withColumn("f1", 2.0 * F.col("shared") / (F.col("ln") + F.col("qn")))
    seen = sized.join(rows.select(*place, "row_label", "known", "cols"), place)
    column = F.when(F.col("year").isNull(), F.get("cols", F.lit(0))).otherwise(F.get(F.filter("cols", lambda c: F.contains(c["column"], F.col("year"))), F.lit(0)))
    seen = seen.withColumn("cell", column).withColumn("confidence", F.col("f1") - PENALTY * F.size(F.array_except("qw", "known")))
    order = F.struct((-F.round("confidence", 9)).alias("c"), "table_id", "row_idx")
    best = seen.filter("cell is not null").groupBy("query_id").agg(F.min_by(F.struct("table_id", "row_idx", "row_label", "cell", "confidence"), order).alias("b"))
    missed = seen.filter(F.col("cell").isNull() & (F.col("f1") >= FLOOR)).groupBy("query_id").agg(F.max_by("row_label", F.struct("table_id", "row_idx")).alias("miss"))
    out = q.select("query_id", "year").join(best, "query_id", "left").join(missed, "query_id", "left")
    weak = F.col("b").isNull() | (F.round("b.confidence", 9) < FLOOR)
    reason = F.when(F.col("miss").isNotNull() & weak, MISSES[0]).when(F.col("b").isNull(), MISSES[1]).when(weak, MISSES[2]).when(F.col("b.cell.value").isNull(), MISSES[3])
    out = out.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    mine = lambda c: F.when(F.col("ok"), F.col(c))
    return out.select(
        "query_id", F.when(F.col("ok"), "answer").otherwise("declined").alias("outcome"), "reason", mine("b.table_id").alias("table_id"),
        F.when(F.col("reason") == MISSES[0], F.col("miss")).otherwise(F.col("b.row_label")).alias("row_label"), mine("b.cell.column").alias("column"), mine("b.cell.raw").alias("raw"), mine("b.cell.unit").alias("unit"),
        mine("b.cell.value").alias("value"), F.col("b.confidence").alias("confidence"), F.when(F.col("ok"), citation(F.col("b.table_id").cast("string"), F.col("b.row_label"), F.col("b.cell.column"))).alias("citation"),
    )


def carried_scale(notes: DataFrame, document: str = "document_id", position: str = "ordinal", note: str = "text") -> DataFrame:
    """Adds scale: the last scale note at or before each row of its document.

    A document's rows are ordered in blocks; only the last note of a block crosses into the next ones.
    """
    df = notes.withColumn("_own", scale_note(F.col(note))).withColumn("_block", F.floor(F.col(position) / 5000))
    inside = F.last("_own", ignorenulls=True).over(Window.partitionBy(document, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    ends = df.groupBy(document, "_block").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col(position))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(document).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(document, "_block", before.alias("_before"))
    return df.withColumn("_in", inside).join(ends, [document, "_block"]).withColumn("scale", F.coalesce("_in", "_before")).drop("_own", "_block", "_in", "_before")


def contradictions(answers: DataFrame) -> DataFrame:
    """Adds contradiction to rows with value (of a resolved cell) and text (narrative): null unless the text states figures none of which
    agrees with the value within half a percent; then what the cell says and the first three figures of the text."""
    stated = extract_numbers(F.col("text"))
    agrees = F.exists("_stated", lambda n: F.abs(n - F.col("value")) <= 0.005 * F.abs("value"))
    first = F.array_join(F.transform(F.slice("_stated", 1, 3), format_figure), ", ")
    message = F.concat(F.lit("table cell resolves to "), format_figure(F.col("value")), F.lit("; narrative states "), first)
    df = answers.withColumn("_stated", stated)
    return df.withColumn("contradiction", F.when(F.col("value").isNotNull() & (F.size("_stated") > 0) & ~agrees, message)).drop("_stated")


def covering_labels(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, table_id, row_label of the rows whose label holds every word of a question but its numbers: questions that were said to have no
    answer, and may have one. questions (query_id, text), rows (table_id, row_label).

    Candidates come from an equi-join on the words; a question without words is covered by nothing.
    """
    words = lambda c: F.filter(question_words(c), lambda w: ~w.rlike("^[0-9]+$"))
    q = questions.select("query_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    each = rows.select("table_id", "row_label").distinct().withColumn("w", F.explode(words(F.col("row_label"))))
    hits = q.select("query_id", "n", F.explode("w").alias("w")).join(each, "w").groupBy("query_id", "table_id", "row_label", "n").agg(F.count("*").alias("shared"))
    return hits.filter("shared = n").select("query_id", "table_id", "row_label")
