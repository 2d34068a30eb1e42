"""Sinks over parquet: upserts, replacement per key, insert-if-absent, caches and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import pair_key, text_key


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The rows of `old` with those of `new` put in by key, new ones winning; of several new rows of one key the one last by `order`.

    A null in a key equals nothing, so such rows of either side all stay, as under a unique constraint. Columns are those of `old`;
    what `new` lacks becomes null.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    whole = ~F.greatest(*[F.col(k).isNull().cast("int") for k in keys]).cast("boolean") if len(keys) > 1 else F.col(keys[0]).isNotNull()
    rank = Window.partitionBy(*keys).orderBy(F.desc("_side"), *([F.desc(order)] if order else []), F.xxhash64(*[c for c in old.columns if c not in keys] or keys))
    kept = both.filter(whole).withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")
    return kept.unionByName(both.filter(~whole)).select(*old.columns)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose key it lacks, one per key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_partitions(new: DataFrame, path: str, key: str) -> None:
    """Rewrite the partitions of the keys in `new`, and no others; rows that a key no longer has are gone."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def replaced(old: DataFrame, new: DataFrame, key: str, emptied: DataFrame | None = None) -> DataFrame:
    """`old` without the keys of `new` (and of `emptied`), and `new`."""
    gone = new.select(key) if emptied is None else new.select(key).unionByName(emptied.select(key))
    return old.join(gone.distinct(), key, "left_anti").unionByName(new)


def ingested(issuers: DataFrame, documents: DataFrame, chunks: DataFrame, known: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issuers, documents, chunks) after an intake: issuers upserted by cik, documents by accession, and the chunks of every document taken in
    replaced by those that came with it, also where none came.

    known: the three tables as they stand. Nothing is written: the caller writes all three to a new place and switches over, so that an
    intake that fails halfway leaves nothing searchable. Chunks of documents that aren't among `documents` are left out.
    """
    old_issuers, old_documents, old_chunks = known
    fresh = chunks.join(documents.select("accession").distinct(), "accession", "left_semi")
    return upserted(old_issuers, issuers, ["cik"]), upserted(old_documents, documents, ["accession"]), replaced(old_chunks, fresh, "accession", emptied=documents.select("accession"))


def corpus_documents(records: DataFrame, prefix: str = "fixture") -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of loose records (id, kind, text, section, speaker, pos): one document per kind, 'filing' where it is null, chunks numbered
    from 0 by pos within it. Numbers come from counts per block of positions, so that a kind of any size spreads over tasks."""
    r = records.withColumn("kind", F.coalesce("kind", F.lit("filing"))).withColumn("accession", F.concat(F.lit(f"{prefix}-"), "kind")).withColumn("_b", F.floor(F.col("pos") / 10_000))
    sizes = r.groupBy("accession", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("accession").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("accession", "_b").orderBy("pos", "id")) - 1
    chunks = r.withColumn("_i", inside).join(sizes.select("accession", "_b", before.alias("_off")), ["accession", "_b"])
    chunks = chunks.select("accession", F.col("id").alias("external_id"), F.col("text").alias("content"), (F.col("_i") + F.col("_off")).cast("int").alias("ordinal"), "section", "speaker")
    return r.select("accession", "kind").distinct(), chunks


def pair_score_cache(pairs: DataFrame) -> DataFrame:
    """key, score: one score per distinct (query, text) pair, keyed by content; of several the smallest counts. Null scores and texts give none."""
    keyed = pairs.select(pair_key(F.col("query"), F.col("text")).alias("key"), F.col("score").cast("float").alias("score"))
    return keyed.filter("key is not null and score is not null").groupBy("key").agg(F.min("score").alias("score"))


def table_json(cells: DataFrame) -> DataFrame:
    """value: every table of `tables.long_cells` as one JSON object with its caption, columns and rows of raw cells, rows in order."""
    rows = cells.groupBy("table_id", "row_idx").agg(F.first("document_id").alias("document_id"), F.first("caption").alias("caption"), F.min("row_label").alias("label"), F.sort_array(F.collect_list(F.struct("col_idx", F.col("column"), F.coalesce("raw", F.lit("")).alias("raw")))).alias("c"))
    one = F.struct("row_idx", F.struct("label", F.transform("c", lambda x: x["raw"]).alias("values")).alias("row"), F.transform("c", lambda x: F.coalesce(x["column"], F.lit(""))).alias("columns"))
    each = rows.groupBy("table_id").agg(F.first("document_id").alias("document_id"), F.first("caption").alias("caption"), F.sort_array(F.collect_list(one)).alias("r"))  # one printed table
    return json_rows(each.select(F.col("table_id").alias("id"), "document_id", "caption", F.col("r")[0]["columns"].alias("columns"), F.transform("r", lambda x: x["row"]).alias("rows")))


def vector_cache(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """key, v: one single-precision vector per distinct text. texts and vectors share doc_id; the smallest doc_id gives the vector."""
    keyed = texts.select("doc_id", text_key(F.col("text")).alias("key")).filter("key is not null").join(vectors.select("doc_id", F.col("v").cast("array<float>").alias("v")), "doc_id")
    return keyed.groupBy("key").agg(F.min_by("v", "doc_id").alias("v"))


def json_rows(df: DataFrame) -> DataFrame:
    """value: every row as a JSON object, nulls left out; write it as text for JSON lines."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
