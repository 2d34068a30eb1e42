"""Street reports: duplicate candidates by place, time and words, groups of duplicates, and physical extent from image masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.numbers import cosine, extent_cm, focal_px, mask_area_m2, rescaled_similarity
from lodestrata.functions.text import jaccard, report_words
from lodestrata.operators.proximity import located, point_of, self_pairs_within
from lodestrata.session import cut


@dataclass(frozen=True)
class DedupeRule:
    """Weights of nearness, words and street segment (which sum to 1), reach in space and time, and the score of a duplicate."""

    w_distance: float = 0.45
    w_text: float = 0.35
    w_segment: float = 0.20
    radius_m: float = 30.0
    window_days: int = 45
    threshold: float = 0.62
    semantic_floor: float | None = None

    def __post_init__(self) -> None:
        if abs(self.w_distance + self.w_text + self.w_segment - 1.0) > 1e-9:
            raise ValueError("weights must sum to 1")


#: The threshold and floor for vectors instead of words.
SEMANTIC = DedupeRule(threshold=0.47, semantic_floor=0.4)


def within_window(a: Column, b: Column, days: int) -> Column:
    """Whether two times are at most `days` apart; true if either is null."""
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) <= days * 86_400_000_000, F.lit(True))


def one_per_source(reports: DataFrame, keys: tuple[str, ...] = ("source", "external_id"), order: str = "id") -> DataFrame:
    """Of rows delivered several times the one with the smallest id; rows with a null key all stay."""
    alone = F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) == 1, F.col(order))
    rank = F.row_number().over(Window.partitionBy(*keys, alone).orderBy(order))
    return reports.withColumn("_r", rank).filter("_r = 1").drop("_r")


def near_pairs(reports: DataFrame, rule: DedupeRule) -> DataFrame:
    """a_id < b_id of the reports within reach of each other, metres, and a_, b_ category, segment_id, reported_at, text_embedding, words.

    Reports join by place alone and meet their other columns by equi-joins; those without a usable point have no pairs.
    """
    near = self_pairs_within(cut(located(reports, "id", "id")), rule.radius_m)
    extra = reports.select("id", "category", "segment_id", "reported_at", "text_embedding", report_words(F.col("description")).alias("words"))
    side = lambda p: extra.select([F.col(c).alias(f"{p}{c}") for c in extra.columns])
    return near.join(side("a_"), "a_id").join(side("b_"), "b_id")


def _score(rule: DedupeRule) -> Column:
    return rule.w_distance * (1 - F.least(F.col("metres") / rule.radius_m, F.lit(1.0))) + rule.w_text * F.coalesce("text_similarity", F.lit(0.0)) + rule.w_segment * F.col("same_segment").cast("double")


def duplicate_candidates(reports: DataFrame, rule: DedupeRule | None = None, limit: int = 25) -> DataFrame:
    """report_id, other_id, metres, same_segment, text_similarity, score, rank: the `limit` likeliest duplicates of every report.

    A report with a null category takes others of any, one with a category, were it empty, only its like. Two missing segments count as the
    same. Distances are great circles on a sphere of 6,371 km, which differ from those on a spheroid by up to half a percent.
    text_similarity is the cosine of the text vectors, null (and 0 in the score) where either has none. Missing times pass.
    """
    rule = rule or DedupeRule()
    pairs = near_pairs(reports, rule).filter(within_window(F.col("a_reported_at"), F.col("b_reported_at"), rule.window_days))
    pairs = pairs.select("a_id", "b_id", "metres", F.col("a_category").alias("ca"), F.col("b_category").alias("cb"), F.col("a_segment_id").eqNullSafe(F.col("b_segment_id")).alias("same_segment"), cosine(F.col("a_text_embedding"), F.col("b_text_embedding")).alias("text_similarity"))
    way = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("report_id", "other_id", "own", "other"), strict=True)])
    ways = F.array(way("a_id", "b_id", "ca", "cb"), way("b_id", "a_id", "cb", "ca"))
    both = pairs.select(F.explode(ways).alias("w"), "metres", "same_segment", "text_similarity").filter(F.col("w.own").isNull() | (F.col("w.own") == F.col("w.other")))
    both = both.select("w.report_id", "w.other_id", "metres", "same_segment", "text_similarity", _score(rule).alias("score"))
    order = Window.partitionBy("report_id").orderBy(F.desc(F.round("score", 9)), "other_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def scored_pairs(reports: DataFrame, rule: DedupeRule | None = None) -> DataFrame:
    """a_id < b_id, metres, in_time, same_segment, text_similarity, score of the pairs in reach whose categories don't differ; an empty category
    differs from none.

    Words, or vectors if the rule names a floor for them, give text_similarity, 0 where either is missing; missing segments are
    never the same. in_time tells whether the pair lies within the rule's days, which the score leaves out.
    """
    rule = rule or DedupeRule()
    pairs = near_pairs(reports, rule).filter(F.coalesce(F.nullif("a_category", F.lit("")) == F.nullif("b_category", F.lit("")), F.lit(True)))
    if rule.semantic_floor is None:
        similarity = jaccard(F.col("a_words"), F.col("b_words"))
    else:
        similarity = rescaled_similarity(cosine(F.col("a_text_embedding"), F.col("b_text_embedding")), rule.semantic_floor)
    in_time = within_window(F.col("a_reported_at"), F.col("b_reported_at"), rule.window_days)
    same = F.coalesce(F.col("a_segment_id") == F.col("b_segment_id"), F.lit(False))
    pairs = pairs.select("a_id", "b_id", "metres", in_time.alias("in_time"), same.alias("same_segment"), similarity.alias("text_similarity"))
    return pairs.withColumn("score", _score(rule))


def duplicates(reports: DataFrame, rule: DedupeRule | None = None) -> DataFrame:
    """a_id, b_id, score of the pairs that count as duplicates."""
    rule = rule or DedupeRule()
    return scored_pairs(reports, rule).filter(F.col("in_time") & (F.round("score", 9) >= rule.threshold)).select("a_id", "b_id", "score")


def least_labels(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """vertex, label: the smallest vertex that edges (a, b) reach, by labels passed along edges and labels' own labels.

    Rounds alternate between taking the least label among neighbours and following labels to theirs, until none changes.
    """
    e = cut(edges.filter("a <> b").select("a", "b"))
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(e.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(most_rounds):
        seen = e.join(labels.withColumnsRenamed({"vertex": "b", "label": "near"}), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("near").alias("near"))
        new = labels.join(seen, "vertex").select("vertex", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("vertex").alias("label"), F.col("label").alias("further"))
        new = cut(new.join(jump, "label").select("vertex", F.least("label", "further").alias("label"), "old"))
        labels = new.select("vertex", "label")
        if new.filter("label <> old").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def clusters(reports: DataFrame, rule: DedupeRule | None = None) -> DataFrame:
    """report_id, cluster_id (the smallest report id) of every report; reports without a duplicate are their own cluster.

    Copies (same point, category, segment, words, vector and time) that the rule takes for duplicates by themselves are one report
    while pairs are made, so that a place that holds very many of them makes no pair of any two.
    """
    rule = rule or DedupeRule()
    lon, lat = point_of(F.col("geom"))
    alike = F.lit(0.0) if rule.semantic_floor is not None else F.when(F.size(report_words(F.col("description"))) > 0, rule.w_text).otherwise(0.0)
    sure = (lat.isNotNull() & (rule.w_distance + alike + F.when(F.col("segment_id").isNotNull(), rule.w_segment).otherwise(0.0) >= rule.threshold)) & F.col("reported_at").isNotNull()
    sure = F.coalesce(sure, F.lit(False))
    # the columns themselves tell copies apart, no hash of them
    same = {"lat": lat + 0.0, "lon": lon + 0.0, "category": F.coalesce("category", F.lit("")), "segment_id": F.col("segment_id"), "description": F.col("description"), "text_embedding": F.col("text_embedding"), "reported_at": F.col("reported_at")}
    mark = F.struct(sure.alias("s"), F.when(~sure, F.col("id")).alias("id"), *[F.when(sure, c).alias(n) for n, c in same.items()])
    marked = reports.withColumn("_m", mark)
    first = marked.groupBy("_m").agg(F.min("id").alias("_first"))
    member = marked.select("id", "_m").join(first, "_m").select(F.col("id").alias("report_id"), F.col("_first").alias("first"))
    needed = reports.select("id", "geom", "category", "description", "segment_id", "reported_at", (F.col("text_embedding") if rule.semantic_floor is not None else F.lit(None).cast("array<float>")).alias("text_embedding"))
    found = duplicates(cut(needed.join(first.select(F.col("_first").alias("id")), "id", "left_semi")), rule)
    labels = least_labels(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return member.join(labels.withColumnRenamed("vertex", "first"), "first", "left").select("report_id", F.coalesce("label", "first").alias("cluster_id"))


def measured_extent(masks: DataFrame, fov_degrees: float = 70.0, oblique: float = 1.0) -> DataFrame:
    """Adds focal, area_m2 and extent_cm to rows with mask_px, depth_m and width; 0 where something isn't positive."""
    df = masks.withColumn("focal", focal_px(F.col("width"), fov_degrees))
    df = df.withColumn("area_m2", mask_area_m2(F.col("mask_px"), F.col("depth_m"), F.col("focal"), oblique))
    return df.withColumn("extent_cm", extent_cm(F.col("area_m2")))


def banded(df: DataFrame, value: str, bands: list[tuple[float, str]], out: str) -> DataFrame:
    """Adds the name of the highest band whose floor the value reaches; null for null and for values under every floor."""
    expression = None
    for floor, name in sorted(bands, reverse=True):
        expression = F.when(F.col(value) >= floor, name) if expression is None else expression.when(F.col(value) >= floor, name)
    return df.withColumn(out, expression)


def report_queue(groups: DataFrame, reports: DataFrame, segments: DataFrame) -> DataFrame:
    """cluster_id, segment_id, street, reports, first_seen, last_seen of every cluster, most reports first, then the earliest; unknown
    times last. groups (report_id, cluster_id). The segment is that of the cluster's first report."""
    r = groups.join(reports.select(F.col("id").alias("report_id"), "segment_id", "reported_at"), "report_id", "left")
    each = r.groupBy("cluster_id").agg(F.count("report_id").alias("reports"), F.min("reported_at").alias("first_seen"), F.max("reported_at").alias("last_seen"), F.min_by("segment_id", "report_id").alias("segment_id"))
    named = each.join(segments.select(F.col("id").alias("segment_id"), F.col("name").alias("street")), "segment_id", "left")
    return named.select("cluster_id", "segment_id", "street", "reports", "first_seen", "last_seen").orderBy(F.desc("reports"), F.asc_nulls_last("first_seen"), "cluster_id")


def open_queue(groups: DataFrame, reports: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of report_queue of groups with an open report (status in any case), with their place in the queue's order."""
    state = groups.join(reports.select(F.col("id").alias("report_id"), F.lower(F.trim("status")).alias("s")), "report_id")
    open_ = state.filter("s = 'open'").select("cluster_id").distinct()
    queue = report_queue(groups, reports, segments).join(open_, "cluster_id", "left_semi")
    return placed(queue, [F.desc("reports"), F.asc_nulls_last("first_seen"), F.asc("cluster_id")], "reports")


def placed(df: DataFrame, order: list[Column], lead: str) -> DataFrame:
    """Adds place (from 1) in the whole order, whose first column, descending, is the integer `lead`: ranks within each of its values, behind
    the counts of the greater ones."""
    sizes = df.groupBy(lead).agg(F.count("*").alias("_n"))  # one row a value
    before = Window.orderBy(F.desc(lead)).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(lead, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(lead).orderBy(*order[1:]))
    return df.withColumn("_in", inside).join(sizes, lead).withColumn("place", F.col("_in") + F.col("_before")).drop("_in", "_before")


def members(groups: DataFrame) -> DataFrame:
    """cluster_id, members: the report ids of every group, ascending. For groups of a size that fits a row; larger ones stay in long form."""
    return groups.groupBy("cluster_id").agg(F.sort_array(F.collect_list("report_id")).alias("members"))
