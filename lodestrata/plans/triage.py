"""Queries over street reports and images: duplicates, their groups and queue, and physical extent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.numbers import bounding_box
from lodestrata.functions.text import NOISE_WORDS
from lodestrata.operators import metrics, triage
from lodestrata.operators.proximity import located, pairs_within
from lodestrata.session import cut, table

THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
BANDS = [(0.0, "small"), (20.0, "medium"), (45.0, "large")]


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports")


def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every report's likeliest duplicates within 30 m and 45 days."""
    out = triage.duplicate_candidates(_reports(spark, d))
    return out.withColumns({"metres": F.round("metres", 4), "text_similarity": F.round("text_similarity", 6), "score": F.round("score", 6)})


def semantic_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return triage.duplicates(_reports(spark, d), triage.SEMANTIC).select("a_id", "b_id", F.round("score", 6).alias("score"))


def report_clusters(spark: SparkSession, d: str) -> DataFrame:
    return triage.clusters(_reports(spark, d))


def first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Reports without the rows delivered again."""
    return triage.one_per_source(_reports(spark, d)).select("id", "source", "external_id")


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d).filter("source is not null and external_id is not null")
    first = r.groupBy("source", "external_id").agg(F.min("id").alias("cluster_id"))
    return r.join(first, ["source", "external_id"]).select(F.col("id").alias("report_id"), "cluster_id")


def report_queue(spark: SparkSession, d: str) -> DataFrame:
    return triage.report_queue(_deliveries(spark, d), _reports(spark, d), table(spark, d, "segments"))


def _judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs with what the matcher said of them."""
    r = _reports(spark, d)
    key = lambda c: F.lower(F.trim(c))
    ids = r.select(key("point_id").alias("p"), "id")
    m = table(spark, d, "report_matches").select(key("point_a").alias("p"), key("point_b").alias("pb")).distinct()
    m = m.join(ids.withColumnRenamed("id", "x"), "p").drop("p").withColumnRenamed("pb", "p").join(ids.withColumnRenamed("id", "y"), "p")
    m = m.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).distinct().withColumn("matched", F.lit(True))
    return triage.scored_pairs(r).join(m, ["a_id", "b_id"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def open_queue(spark: SparkSession, d: str) -> DataFrame:
    """The same of groups that are still open, gravest first: by reports, standing in for severity."""
    return triage.open_queue(_deliveries(spark, d), _reports(spark, d), table(spark, d, "segments"))


def dedupe_report(spark: SparkSession, d: str) -> DataFrame:
    """Pair metrics at the rule's threshold; pairs of two segments are the hard ones."""
    pairs = cut(_judged_pairs(spark, d).select(F.col("matched").alias("truth"), (F.col("in_time") & (F.round("score", 9) >= triage.DedupeRule().threshold)).alias("said"), "same_segment"))
    return metrics.dedupe_report(pairs, hard=~F.col("same_segment")).withColumn("value", F.round("value", 6))


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of every group of deliveries, in order, as one text."""
    return triage.members(_deliveries(spark, d)).select("cluster_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def duplicate_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the score against accepted matches, per threshold."""
    pairs = _judged_pairs(spark, d).withColumn("score", F.round("score", 9))
    return metrics.threshold_sweep(pairs, "matched", "score", THRESHOLDS).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def duplicate_quality(spark: SparkSession, d: str) -> DataFrame:
    """The same at the rule's threshold, for all pairs and for those on one segment."""
    pairs = cut(_judged_pairs(spark, d).select("matched", (F.col("in_time") & (F.round("score", 9) >= triage.DedupeRule().threshold)).alias("said"), "same_segment"))
    parts = pairs.withColumn("slice", F.explode(F.array(F.lit("all"), F.when(F.col("same_segment"), "one segment").otherwise("two segments"))))
    out = metrics.binary_scores(parts, "matched", "said", ["slice"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _masks(spark: SparkSession, d: str) -> DataFrame:
    """Images with a report within 30 m: the nearest one's distance as depth, and as mask the part of the picture that the camera's angle names."""
    i = table(spark, d, "images")
    near = pairs_within(cut(located(_reports(spark, d), "id", "lid")), cut(located(i, "id", "rid")), 30.0).groupBy(F.col("rid").alias("id")).agg(F.min("metres").alias("depth_m"))
    part = F.col("width") * F.col("height") * F.pmod("compass_angle", F.lit(360.0)) / 3600.0
    return i.select("id", "width", part.alias("mask_px")).join(near, "id")


def mask_extents(spark: SparkSession, d: str) -> DataFrame:
    out = triage.banded(triage.measured_extent(_masks(spark, d)), "extent_cm", BANDS, "band")
    return out.select("id", F.round("area_m2", 6).alias("area_m2"), F.round("extent_cm", 4).alias("extent_cm"), "band")


def report_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A 40 m search box around every located report."""
    r = located(_reports(spark, d), "id", "id").withColumn("b", bounding_box(F.col("lat"), F.col("lon"), F.lit(40.0)))
    return r.select("id", *[F.round(f"b.{c}", 8).alias(c) for c in ("west", "south", "east", "north")])


def missing_locations(spark: SparkSession, d: str) -> DataFrame:
    """Reports, and those without a usable place, per source."""
    r = _reports(spark, d)
    placed = located(r, "id", "id").select("id", F.lit(1).alias("placed"))
    return r.select("id", "source").join(placed, "id", "left").groupBy("source").agg(F.count("*").alias("reports"), F.count_if(F.col("placed").isNull()).alias("unplaced"))


QUERIES = {
    "duplicate_candidates": duplicate_candidates, "semantic_duplicates": semantic_duplicates, "report_clusters": report_clusters, "first_deliveries": first_deliveries, "report_queue": report_queue, "open_queue": open_queue, "dedupe_report": dedupe_report, "cluster_members": cluster_members,
    "duplicate_sweep": duplicate_sweep, "duplicate_quality": duplicate_quality, "mask_extents": mask_extents, "report_boxes": report_boxes, "missing_locations": missing_locations,
}

_NUM = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_WKT = r"(?i)^\s*(?:srid\s*=\s*\d+\s*;)?\s*point\s*(?:zm|z|m)?\s*\(\s*" + _NUM + r"\s+" + _NUM + r"(?:\s+[^()]*)?\)\s*$"
_JSON = r'(?i)"coordinates"\s*:\s*\[\s*' + _NUM + r"\s*,\s*" + _NUM


def points_sql(name: str) -> str:
    """A select of id, lon, lat of a table's usable points."""
    part = lambda n: f"try_cast(coalesce(nullif(regexp_extract(g, '{_WKT}', {n}), ''), case when regexp_matches(g, '(?i)\"type\"\\s*:\\s*\"point\"') then nullif(regexp_extract(g, '{_JSON}', {n}), '') end) as double)"
    return f"(select id, lon, lat from (select id, {part(1)} as lon, {part(2)} as lat from (select id, regexp_replace(geom, '\\s+', ' ', 'g') as g from {name})) where lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0))"


def metres_sql(a: str, b: str) -> str:
    return (
        f"(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"
    )


_NOISE = f"({', '.join(f"'{w}'" for w in NOISE_WORDS)})"
_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9]+'), lambda t: t not in {_NOISE}))"


def _pairs(similarity: str, category: str, same: str = "coalesce(a.segment_id = b.segment_id, false)", gate: str = "true") -> str:
    return f"""
pt as materialized {points_sql('reports')},
xx as materialized (select a.id as a_id, b.id as b_id, {metres_sql('a', 'b')} as metres from pt a join pt b on a.id < b.id and b.lat between a.lat - 0.0004 and a.lat + 0.0004 where {metres_sql('a', 'b')} <= 30),
rx as (select id, category, segment_id, reported_at, text_embedding, {_WORDS} as w from reports),
pb as (select a_id, b_id, metres, {same} as same_segment, {similarity} as text_similarity, a.category as ca, b.category as cb,
  coalesce(abs(epoch_us(a.reported_at) - epoch_us(b.reported_at)) <= 45 * 86400000000, true) as in_time from xx join rx a on a.id = a_id join rx b on b.id = b_id where {category}),
pa as (select * from pb where {gate}),
sc as (select *, 0.45 * (1 - least(metres / 30, 1.0)) + 0.35 * coalesce(text_similarity, 0) + 0.2 * same_segment::int as score from pa)"""


_JACCARD = "case when len(a.w) > 0 and len(b.w) > 0 then len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) else 0.0 end"
_NAMED = "not coalesce(nullif(a.category, '') <> nullif(b.category, ''), false)"
_COSINE = "case when len(a.text_embedding) = len(b.text_embedding) and len(list_filter(a.text_embedding, lambda x: x <> 0)) > 0 and len(list_filter(b.text_embedding, lambda x: x <> 0)) > 0 then list_cosine_similarity(a.text_embedding::double[], b.text_embedding::double[]) end"
_SEMANTIC = f"coalesce(greatest(0.0, least(1.0, (({_COSINE}) - 0.4) / 0.6)), 0.0)"
_JUDGED = f"""{_pairs(_JACCARD, _NAMED)},
ma as (select distinct least(x.id, y.id) as a_id, greatest(x.id, y.id) as b_id from report_matches m join reports x on lower(trim(x.point_id)) = lower(trim(m.point_a)) join reports y on lower(trim(y.point_id)) = lower(trim(m.point_b))),
ju as (select sc.*, ma.a_id is not null as matched from sc left join ma on ma.a_id = sc.a_id and ma.b_id = sc.b_id)"""

SQL = {
    "duplicate_candidates": f"""with {_pairs(_COSINE, "true", "a.segment_id is not distinct from b.segment_id", "in_time")},
bo as (select a_id as report_id, b_id as other_id, * exclude (a_id, b_id) from sc where ca is null or ca = cb union all by name
  select b_id as report_id, a_id as other_id, * exclude (a_id, b_id) from sc where cb is null or ca = cb)
select report_id, other_id, round(metres, 4) as metres, same_segment, round(text_similarity, 6) as text_similarity, round(score, 6) as score, rank
from (select *, row_number() over (partition by report_id order by round(score, 9) desc, other_id) as rank from bo) where rank <= 25""",
    "semantic_duplicates": f"with {_pairs(_SEMANTIC, _NAMED, gate="in_time")} select a_id, b_id, round(score, 6) as score from sc where round(score, 9) >= 0.47",
    "report_clusters": f"""with recursive {_pairs(_JACCARD, _NAMED, gate="in_time")},
du as (select a_id, b_id from sc where round(score, 9) >= 0.62), un as materialized (select a_id as a, b_id as b from du union select b_id, a_id from du),
re as (select a as v, a as r from un union select un.b, re.r from re join un on un.a = re.v),
la as (select v, min(r) as label from re group by v)
select id as report_id, coalesce(label, id) as cluster_id from reports left join la on la.v = id""",
    "first_deliveries": "select id, source, external_id from (select *, row_number() over (partition by source, external_id order by id) as r from reports) where r = 1 or source is null or external_id is null",
    "report_queue": """
with g as (select id, min(id) over (partition by source, external_id) as cluster_id, segment_id, reported_at from reports where source is not null and external_id is not null)
select cluster_id, first(segment_id order by g.id) as segment_id, (select name from segments s where s.id = first(g.segment_id order by g.id)) as street, count(*) as reports, min(reported_at) as first_seen, max(reported_at) as last_seen
from g group by cluster_id""",
    "open_queue": """
with g as (select id, min(id) over (partition by source, external_id) as cluster_id, segment_id, reported_at, status from reports where source is not null and external_id is not null),
q as (select cluster_id, first(segment_id order by id) as segment_id, count(*) as reports, min(reported_at) as first_seen, max(reported_at) as last_seen, bool_or(lower(trim(status)) = 'open') as open from g group by 1)
select cluster_id, segment_id, s.name as street, reports, first_seen, last_seen, row_number() over (order by reports desc, first_seen nulls last, cluster_id) as place from q left join segments s on s.id = segment_id where open""",
    "dedupe_report": f"""with {_JUDGED}, p as (select matched as t, in_time and round(score, 9) >= 0.62 as p, same_segment from ju),
c as (select count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, avg((t = p)::int) as acc, avg((p and not t)::int) as fm, avg((t = p)::int) filter (not same_segment) as hard from p)
select x.m as metric, round(x.v::double, 6) as value from (select unnest([{{'m': 'pair_precision', 'v': case when tp + fp > 0 then tp / (tp + fp) else 0 end}}, {{'m': 'pair_recall', 'v': case when tp + fn > 0 then tp / (tp + fn) else 0 end}},
  {{'m': 'pair_f1', 'v': case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end}}, {{'m': 'pair_support', 'v': tp + fn}}, {{'m': 'accuracy', 'v': acc}}, {{'m': 'false_merge_rate', 'v': fm}}, {{'m': 'accuracy.hard', 'v': hard}}]) as x from c) where x.v is not null""",
    "cluster_members": """
with g as (select id, min(id) over (partition by source, external_id) as cluster_id from reports where source is not null and external_id is not null)
select cluster_id, string_agg(id, ',' order by id) as members from g group by 1""",
    "duplicate_sweep": f"""with {_JUDGED}
select threshold, count(*) filter (matched and p) as tp, count(*) filter (not matched and p) as fp, count(*) filter (matched and not p) as fn,
  round(case when count(*) filter (p) > 0 then count(*) filter (matched and p) / count(*) filter (p) else 0 end, 6) as precision,
  round(case when count(*) filter (matched) > 0 then count(*) filter (matched and p) / count(*) filter (matched) else 0 end, 6) as recall
from (select matched, threshold, round(score, 9) >= threshold as p from ju, (select unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::double as threshold)) group by threshold""",
    "duplicate_quality": f"""with {_JUDGED}, sl as (select matched, in_time and round(score, 9) >= 0.62 as p, unnest(['all', case when same_segment then 'one segment' else 'two segments' end]) as slice from ju),
c as (select slice, count(*) filter (matched and p) as tp, count(*) filter (not matched and p) as fp, count(*) filter (matched and not p) as fn from sl group by slice)
select slice, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
  round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, tp + fn as support from c""",
    "mask_extents": f"""
with r as materialized {points_sql('reports')}, im as materialized {points_sql('images')},
ne as (select im.id, min({metres_sql('r', 'im')}) as depth from r join im on im.lat between r.lat - 0.0004 and r.lat + 0.0004 where {metres_sql('r', 'im')} <= 30 group by 1),
m as (select i.id, width, width::bigint * height * (((compass_angle % 360) + 360) % 360) / 3600.0 as px, depth from images i join ne on ne.id = i.id),
a as (select id, case when px > 0 and width > 0 and depth > 0 then px * pow(depth / (width / 2.0 / tan(radians(70) / 2)), 2) else 0.0 end as area from m)
select id, round(area, 6) as area_m2, round(200 * sqrt(area / pi()), 4) as extent_cm, case when 200 * sqrt(area / pi()) >= 45 then 'large' when 200 * sqrt(area / pi()) >= 20 then 'medium' else 'small' end as band from a""",
    "report_boxes": f"""
select id, round(lon - 40 / (111320.0 * greatest(abs(cos(radians(lat))), 1e-6)), 8) as west, round(lat - 40 / 111320.0, 8) as south,
  round(lon + 40 / (111320.0 * greatest(abs(cos(radians(lat))), 1e-6)), 8) as east, round(lat + 40 / 111320.0, 8) as north from {points_sql('reports')}""",
    "missing_locations": f"select source, count(*) as reports, count(*) filter (p.id is null) as unplaced from reports r left join {points_sql('reports')} p on p.id = r.id group by source",
}
