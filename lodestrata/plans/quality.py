"""Queries of evaluation: raters' agreement, calibration, detections, and gates over metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.numbers import bounding_box
from lodestrata.operators import metrics
from lodestrata.operators.proximity import located
from lodestrata.plans.triage import points_sql
from lodestrata.session import cut, table

THRESHOLDS = [0.5, 0.75]


def _raters(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, kind, a, b: the labels of the alphabetically first and last rater of each document that has two."""
    each = table(spark, d, "doc_labels").groupBy("doc_id").agg(F.min_by("label", "rater").alias("a"), F.max_by("label", "rater").alias("b"), F.countDistinct("rater").alias("n"))
    kinds = table(spark, d, "documents").select("doc_id", "kind")
    return each.filter("n > 1").join(kinds, "doc_id").select("doc_id", "kind", F.lower(F.trim("a")).alias("a"), F.lower(F.trim("b")).alias("b"))


def rater_kappa(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.kappa(_raters(spark, d), "a", "b")
    return out.withColumns({c: F.round(c, 6) for c in ("observed", "expected", "kappa")})


def rater_kappa_by_kind(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.kappa(_raters(spark, d), "a", "b", ["kind"])
    return out.withColumns({c: F.round(c, 6) for c in ("observed", "expected", "kappa")})


def rater_scores(spark: SparkSession, d: str) -> DataFrame:
    """The first rater's cases against the last rater's, per kind of document."""
    rows = _raters(spark, d).select("kind", (F.col("b") != "none").alias("truth"), (F.col("a") != "none").alias("said"))
    return metrics.binary_scores(rows, "truth", "said", ["kind"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def match_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The matcher's scores against whether both reports have one category."""
    key = lambda c: F.lower(F.trim(c))
    side = table(spark, d, "reports").select(key("point_id").alias("p"), "category")
    m = table(spark, d, "report_matches").select(key("point_a").alias("p"), key("point_b").alias("q"), "score").filter("score is not null")
    m = m.join(side, "p").drop("p").withColumnsRenamed({"category": "ca", "q": "p"}).join(side, "p")
    out = metrics.calibration(m.withColumn("ok", F.col("ca") == F.col("category")), "score", "ok")
    return out.withColumns({c: F.round(c, 6) for c in ("confidence", "accuracy", "gap")})


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every located report's box of 40 m under its category, and as predictions the boxes of the reports that a matcher took for the same,
    under their own category, with its score."""
    key = lambda c: F.lower(F.trim(c))
    r = table(spark, d, "reports")
    box = bounding_box(F.col("lat"), F.col("lon"), F.lit(40.0))
    box = F.struct(box["west"].alias("x1"), box["south"].alias("y1"), box["east"].alias("x2"), box["north"].alias("y2"))
    boxes = located(r, "id", "id").select("id", box.alias("box"))
    known = r.filter("category is not null").select(key("point_id").alias("p"), "id", F.col("category").alias("label")).join(boxes, "id")
    truth = known.select(F.col("id").alias("image_id"), "label", F.col("id").alias("pos"), "box")
    m = table(spark, d, "report_matches").filter("score is not null").select(F.col("match_id").alias("pos"), "score", key("point_a").alias("p"), key("point_b").alias("q"))
    said = m.join(known.select("p", F.col("id").alias("image_id")), "p").drop("p").withColumnRenamed("q", "p").join(known.select("p", "label", "box"), "p")
    return said.select("image_id", "label", "pos", "score", "box"), truth


def detection_precision(spark: SparkSession, d: str) -> DataFrame:
    said, truth = _boxes(spark, d)
    return metrics.average_precision(cut(said), cut(truth), THRESHOLDS).withColumn("ap", F.round("ap", 6))


def detection_report(spark: SparkSession, d: str) -> DataFrame:
    said, truth = _boxes(spark, d)
    return metrics.detection_report(cut(said), cut(truth)).withColumn("value", F.round("value", 6))


def source_gates(spark: SparkSession, d: str) -> DataFrame:
    """Share of documents with text per source, gated against that of the documents before 2031."""
    docs = table(spark, d, "documents").filter("source is not null").withColumn("whole", F.col("text").isNotNull().cast("double"))
    now = docs.groupBy(F.col("source").alias("metric")).agg(F.avg("whole").alias("value"))
    prior = docs.filter("published_at < timestamp '2031-01-01 00:00:00'").groupBy(F.col("source").alias("metric")).agg(F.avg("whole").alias("prior"))
    gates = now.select("metric", F.lit(0.9).alias("min_value"), F.lit(1.0).alias("max_value"), F.lit(0.001).alias("max_regression"), F.lit(True).alias("higher_is_better"))
    return metrics.gate_results(now, prior, gates).withColumns({"value": F.round("value", 6), "prior": F.round("prior", 6)})


QUERIES = {
    "rater_kappa": rater_kappa, "rater_kappa_by_kind": rater_kappa_by_kind, "rater_scores": rater_scores, "match_calibration": match_calibration, "detection_precision": detection_precision, "detection_report": detection_report, "source_gates": source_gates,
}

_RATERS = """ra as (select doc_id, kind, lower(trim(a)) as a, lower(trim(b)) as b from (
  select doc_id, arg_min(label, rater) as a, arg_max(label, rater) as b from doc_labels group by doc_id having count(distinct rater) > 1) join documents using (doc_id)),
rb as (select * from ra where a is not null and b is not null)"""


def _kappa(by: str) -> str:
    key, using = (f"{by}, ", f"using ({by})") if by else ("", "on true")
    group = f"group by {by}" if by else ""
    return f"""with {_RATERS},
t as (select {key}count(*) as n, avg((a = b)::int) as observed from rb {group}),
m as (select {key}l, count(*) filter (s = 0) as na, count(*) filter (s = 1) as nb from (select {key}a as l, 0 as s from rb union all select {key}b, 1 from rb) group by {key}l),
e as (select {key}sum(na * nb) as x from m {group})
select {key}n, round(observed, 6) as observed, round(x / (n * n), 6) as expected, round(case when x = n * n then 1.0 else (observed - x / (n * n)) / (1 - x / (n * n)) end, 6) as kappa from t join e {using}"""


_SIDE = "40 / (111320.0 * greatest(abs(cos(radians(lat))), 1e-6))"
# one box an image and label: the first prediction in order that overlaps it enough is the hit
_AP = f"""kn as (select lower(trim(point_id)) as p, r.id, category as label, lon - {_SIDE} as x1, lat - 40 / 111320.0 as y1, lon + {_SIDE} as x2, lat + 40 / 111320.0 as y2 from reports r join {points_sql('reports')} g on g.id = r.id where category is not null),
sa as (select a.id as image_id, b.label, match_id as pos, score, b.x1, b.y1, b.x2, b.y2 from report_matches m join kn a on a.p = lower(trim(point_a)) join kn b on b.p = lower(trim(point_b)) where score is not null),
ov as (select s.image_id, s.label, s.pos, s.score, case when t.id is null then 0 else greatest(0, least(s.x2, t.x2) - greatest(s.x1, t.x1)) * greatest(0, least(s.y2, t.y2) - greatest(s.y1, t.y1)) end as i, (s.x2 - s.x1) * (s.y2 - s.y1) + coalesce((t.x2 - t.x1) * (t.y2 - t.y1), 0) as u from sa s left join kn t on t.id = s.image_id and t.label = s.label),
io as (select *, case when i > 0 then i / (u - i) else 0 end as iou from ov),
th as (select unnest({{thresholds}})::double as threshold), lb as (select label, count(*) as boxes from kn group by 1),
hi as (select io.*, threshold, iou >= threshold and row_number() over (partition by threshold, image_id, label, iou >= threshold order by score desc, pos) = 1 as tp from io, th),
ru as (select *, sum(tp::int) over d as t, row_number() over d as n from hi window d as (partition by threshold, label order by score desc, image_id, pos rows unbounded preceding)),
en as (select *, max(t / n) over (partition by threshold, label order by score desc, image_id, pos rows between current row and unbounded following) as p from ru),
ap as (select threshold, label, coalesce(ap, 0) as ap from lb cross join th left join (select threshold, label, sum(case when tp then p / boxes else 0 end) as ap from en join lb using (label) group by 1, 2) using (threshold, label))"""


SQL = {
    "detection_precision": f"with {_AP.format(thresholds='[0.5, 0.75]')} select threshold, label, round(ap, 6) as ap from ap",
    "detection_report": f"""with {_AP.format(thresholds='[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]')},
ca as (select greatest(ceil(score * 10) - 1, 0)::int as bin, score, iou >= 0.5 as ok from io where score between 0 and 1),
ce as (select coalesce(sum(g), 0) as ece from (select count(*) / (select count(*) from io) * abs(avg(score) - avg(ok::int)) as g from ca group by bin))
select 'map_50_95' as metric, round(coalesce(avg(ap), 0), 6) as value from ap union all select 'map_50', round(coalesce(avg(ap), 0), 6) from ap where threshold = 0.5 union all select 'ap_50.' || label, round(ap, 6) from ap where threshold = 0.5
union all select 'ece', round(ece, 6) from ce union all select 'n_predictions', (select count(*) from io)::double""",
    "rater_kappa": _kappa(""),
    "rater_kappa_by_kind": _kappa("kind"),
    "rater_scores": f"""with {_RATERS}, s as (select kind, coalesce(b <> 'none', false) as t, coalesce(a <> 'none', false) as p from ra),
c as (select kind, count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn from s group by kind)
select kind, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
  round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, tp + fn as support from c""",
    "match_calibration": """
with m as (select score, coalesce(x.category = y.category, false) as ok from report_matches m join reports x on lower(trim(x.point_id)) = lower(trim(point_a)) join reports y on lower(trim(y.point_id)) = lower(trim(point_b)) where score is not null),
b as (select greatest(ceil(score * 10) - 1, 0)::int as bin, score, ok from m where score between 0 and 1)
select bin, count(*) as n, round(avg(score), 6) as confidence, round(avg(ok::int), 6) as accuracy, round(count(*) / (select count(*) from m) * abs(avg(score) - avg(ok::int)), 6) as gap from b group by bin""",
    "source_gates": """
with n as (select source as metric, avg((text is not null)::int) as value, avg(case when published_at < timestamp '2031-01-01' then (text is not null)::int end) as prior from documents where source is not null group by source),
v as (select metric, value, prior, case when value < 0.9 then 'below floor' when value > 1 then 'above ceiling' when prior - value > 0.001 then 'regressed' when prior is null then 'no baseline yet' else 'ok' end as verdict from n)
select metric, round(value, 6) as value, round(prior, 6) as prior, verdict, verdict in ('ok', 'no baseline yet') as passed from v""",
}
