"""Queries of the text problems; SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import abuse, chunking, components, garble, neighbours, packing, tokens, transcripts
from lodestrata.session import cut, spread, table


def _events(spark: SparkSession, d: str, texts: bool) -> DataFrame:
    return transcripts.speech_events(spread(table(spark, d, "chunks")), table(spark, d, "speakers"), texts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_turns(spark, d).select("document_id", "speaker_no", "first_chunk_id", "last_chunk_id")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.turns(_events(spark, d, False))


def p2_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Clean utterances with their turn, canonical speaker and repaired times."""
    said = transcripts.with_turns(_events(spark, d, True))
    return said.select("document_id", "turn", "speaker_no", F.col("id").alias("chunk_id"), "seq", "start_s", "end_s", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "reports").select("id", F.col("text_embedding").alias("v"))
    images = table(spark, d, "images").select("id", F.col("image_embedding").alias("v"))
    near = [neighbours.similar_pairs(spread(df), width).select(F.lit(name).alias("table_name"), "id_a", "id_b") for name, df, width in (("reports", reports, 384), ("images", images, 512))]
    return near[0].unionByName(near[1])


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(spread(table(spark, d, "chunks").select("id", "content", "char_start", "section")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).filter("piece = 0").select("chunk_id", "forced")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "report_matches"), table(spark, d, "reports"))


def _printed(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "table_cells").select(F.lit("table_cells").alias("table_name"), F.col("cell_id").alias("record_id"), F.col("raw").alias("text"))
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("table_name"), F.col("id").alias("record_id"), F.col("content").alias("text"))
    return cells.unionByName(spread(chunks))


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.find_garbled(_printed(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_restored(spark, d).select("table_name", "record_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(spread(table(spark, d, "documents").select("doc_id", "text")).filter("text <> ''"))
    return packing.pack(cut(sizes))  # encoded once, ranked and counted from the checkpoint


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, d))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(spread(table(spark, d, "documents")), table(spark, d, "doc_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).filter("found").select("doc_id")


QUERIES = {
    "p2_found": p2_found, "p2_turns": p2_turns, "p2_utterances": p2_utterances,
    "p3_found": p3_found, "p4_pieces": p4_pieces, "p4_found": p4_found, "p5_found": p5_found, "p6_restored": p6_restored, "p6_found": p6_found,
    "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill,
    "p10_scores": p10_scores, "p10_rates": p10_rates, "p10_found": p10_found,
}

_SQL_GROUPS = """
with recursive ids as (select lower(trim(point_id)) as p, id from reports where point_id is not null),
e as (select distinct x.id as a, y.id as b from report_matches m join ids x on x.p = lower(trim(m.point_a))
      join ids y on y.p = lower(trim(m.point_b)) where x.id <> y.id),
u as (select a, b from e union select b, a from e),
reach as (select a as v, a as r from u union select u.b, reach.r from reach join u on u.a = reach.v)
select v as report_id, min(r) as group_id from reach group by v"""

_SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"[\n-\r\x{2028}\x{2029}]"
# every boundary becomes one line break, then the longest line tells
_SQL_FORCED = f"""
select id as chunk_id, (list_max(list_transform(string_split_regex(marked, '{_SPACE}*{_BREAK}+{_SPACE}*'), lambda x: length(x))) > 1200)::int as forced
from (select id, regexp_replace(regexp_replace(content, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '([.!?]){_SPACE}+', '\\1' || chr(10), 'g') as marked from chunks where length(content) > 1200)"""

SQL = {"p4_found": _SQL_FORCED, "p5_found": _SQL_GROUPS}
