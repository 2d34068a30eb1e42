"""Evaluation metrics as aggregations: retrieval, agreement, calibration, detection, reports of several metrics, and gates over them.

Every function takes and returns DataFrames; grouping columns (`by`) come first in the result, so that headline figures and slices
come from one definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.numbers import iou, numeric_match
from lodestrata.session import cut


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ranking_quality(gold: DataFrame, ranking: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, precision, rr, ndcg at k, per question of `gold`.

    gold (query_id, doc_id, gain optional, 1 by default), ranking (query_id, doc_id, rank). Questions without a hit score 0; rr looks
    beyond k. Repeated gold rows count once, with their greatest gain.
    """
    gain = F.col("gain").cast("double") if "gain" in gold.columns else F.lit(1.0)
    g = gold.groupBy("query_id", "doc_id").agg(F.max(gain).alias("gain"))
    ideal = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    g = g.withColumn("place", F.row_number().over(ideal))
    hit = g.join(ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")), ["query_id", "doc_id"], "left")
    discount = lambda c: F.col("gain") / F.log2(F.col(c) + 1.0)
    out = hit.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, discount("rank"))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(F.col("place") <= k, discount("place"))), F.lit(0.0)).alias("idcg"),
    )
    return out.select(
        "query_id", (F.col("hits") / F.col("n")).alias("recall"), (F.col("hits") / F.lit(float(k))).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), share(F.col("dcg"), F.col("idcg")).alias("ndcg"),
    )


def binary_scores(rows: DataFrame, truth: str, said: str, by: list[str] | None = None) -> DataFrame:
    """by..., tp, fp, fn, precision, recall, f1, support. Null truth or answer counts as false."""
    t, p = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(said), F.lit(False))
    out = rows.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "support": tp + fn})


def threshold_sweep(scored: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall: each row is counted once, under every threshold it reaches."""
    each = scored.select(F.coalesce(F.col(truth), F.lit(False)).alias("t"), F.col(score).alias("s"), F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    return binary_scores(each.withColumn("p", F.col("s") >= F.col("threshold")), "t", "p", ["threshold"]).drop("f1", "support")


def kappa(rows: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """by..., n, observed, expected, kappa of two raters' labels. Rows in which either is null are left out; full chance agreement
    gives 1; no rows give no row."""
    by = by or []
    pairs = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    counts = pairs.groupBy(*by, "_a", "_b").agg(F.count("*").alias("_n"))
    sides = counts.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_a").alias("l")), F.struct(F.lit(1).alias("side"), F.col("_b").alias("l")))).alias("s"), "_n")
    margins = sides.groupBy(*by, F.col("s.l").alias("l")).agg(F.sum(F.when(F.col("s.side") == 0, F.col("_n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("s.side") == 1, F.col("_n")).otherwise(0)).alias("nb"))
    chance = margins.groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("same"))
    both = total.join(chance, by) if by else total.crossJoin(F.broadcast(chance))  # one row each
    both = both.withColumn("observed", F.col("same") / F.col("n")).withColumn("expected", F.col("cross") / (F.col("n").cast("double") * F.col("n")))
    value = F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return both.select(*by, "n", "observed", "expected", value.alias("kappa"))


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy, gap (weighted), over equal bins (lo, hi], the first with 0. Confidences outside 0 to 1 are in no
    bin but count in the weights; summing gap gives the expected calibration error."""
    c = F.col(confidence)
    total = rows.agg(F.count("*").alias("total"))  # one row
    about = F.greatest(F.ceil(c * bins) - 1, F.lit(0)).cast("int")
    # the product may round past a bound that the quotient has exactly
    exact = F.when((about > 0) & (c <= about / F.lit(float(bins))), about - 1).when(c > (about + 1) / F.lit(float(bins)), about + 1).otherwise(about)
    inside = rows.filter(c.between(0, 1)).withColumn("bin", exact)
    out = inside.groupBy("bin").agg(F.count("*").alias("n"), F.avg(c).alias("confidence"), F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("double")).alias("accuracy"))
    gap = F.col("n") / F.col("total") * F.abs(F.col("confidence") - F.col("accuracy"))
    return out.crossJoin(F.broadcast(total)).withColumn("gap", gap).drop("total")


def _hits(predictions: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """image_id, label, score, pos, tp (a boolean per threshold), a row per prediction that has a score; see matched_detections.

    Rows come sorted by image and label and pass through Python in batches, whatever the number of images."""
    t = truth.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "box"))).alias("boxes"))  # one image's boxes of one label
    near = predictions.filter("score is not null").join(t, ["image_id", "label"], "left")
    overlaps = F.transform("boxes", lambda b: iou(F.col("box"), b["box"]))
    order = Window.partitionBy("image_id", "label").orderBy(F.desc("score"), "pos", "box")
    rows = near.withColumns({"overlaps": overlaps, "place": F.row_number().over(order)}).select("image_id", "label", "score", "pos", "overlaps", "place")

    def greedy(batches):
        taken: list[set] = []
        for pdf in batches:
            tp = []
            for place, overlaps in zip(pdf.place.tolist(), pdf.overlaps, strict=True):
                if place == 1:  # another image or label
                    taken = [set() for _ in thresholds]
                own = [] if overlaps is None else sorted((-o, i) for i, o in enumerate(overlaps))
                hit = []
                for threshold, gone in zip(thresholds, taken, strict=True):
                    free = next((i for o, i in own if -o >= threshold and i not in gone), None)
                    hit.append(free is not None)
                    if free is not None:
                        gone.add(free)
                tp.append(hit)
            yield pdf[["image_id", "label", "score", "pos"]].assign(tp=tp)

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInPandas(greedy, ", ".join(f"{c} {fields[c]}" for c in ("image_id", "label", "score", "pos")) + ", tp array<boolean>")
    # pandas gives NaN back as null
    return out.withColumn("score", F.coalesce("score", F.lit(float("nan")).cast(fields["score"]))) if fields["score"] in ("double", "float") else out


def _at_thresholds(thresholds: list[float]) -> Column:
    return F.explode(F.arrays_zip(F.array(*[F.lit(float(x)) for x in thresholds]).alias("threshold"), F.col("tp").alias("tp")))


def matched_detections(predictions: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, label, image_id, score, pos, tp: predictions taken by score, each with the best box of its image and label that no
    earlier one took, if they overlap enough.

    predictions (image_id, label, score, pos, box), truth (image_id, label, pos, box); pos orders what has one score. Predictions without a
    score give no row; NaN is the highest score.
    """
    each = _hits(predictions, truth, thresholds).select("label", "image_id", "score", "pos", _at_thresholds(thresholds).alias("m"))
    return each.select("m.threshold", "label", "image_id", "score", "pos", "m.tp")


#: Score ranges that a label's predictions are ranked in.
RANGES = 1000


def average_precision(predictions: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, label, ap for every label of `truth`; a label without predictions scores 0.

    Predictions are ranked inside ranges of score, once for all thresholds; sums before and the best precision behind a range come from one
    row per range. Only hits are carried on: precision rises at them alone.
    """
    labels = truth.groupBy("label").agg(F.count("*").alias("boxes"))
    score = F.col("score").cast("double")
    top = F.lit((1 << 63) - 1)
    hits = _hits(predictions, truth, thresholds).join(labels.select("label"), "label").withColumn("range", F.when(F.isnan(score), top).otherwise(F.floor(score * RANGES)))
    hits = cut(hits)  # matched once, read by several stages
    key = ["threshold", "label"]
    counts = hits.groupBy("label", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("label", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    place = F.row_number().over(Window.partitionBy("label", "range").orderBy(F.desc("score"), "image_id", "pos", F.desc("tp")))
    run = hits.withColumn("n", place).filter(F.exists("tp", lambda x: x)).join(counts, ["label", "range"])
    run = run.select("label", "range", (F.col("n") + F.col("n0")).alias("n"), _at_thresholds(thresholds).alias("m")).filter("m.tp").select("m.threshold", "label", "range", "n")
    found = run.groupBy(*key, "range").agg(F.count("*").alias("t"))
    before = Window.partitionBy(*key).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(*key, "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    down = Window.partitionBy(*key, "range").orderBy("n")
    run = run.withColumn("t", F.row_number().over(down)).join(found, [*key, "range"])
    run = run.withColumn("precision", (F.col("t") + F.col("t0")) / F.col("n"))
    behind = Window.partitionBy(*key).orderBy(F.desc("range")).rowsBetween(1, Window.unboundedFollowing)
    best = run.groupBy(*key, "range").agg(F.max("precision").alias("p")).select(*key, "range", F.max("p").over(behind).alias("later"))
    run = run.withColumn("envelope", F.max("precision").over(down.rowsBetween(0, Window.unboundedFollowing))).join(best, [*key, "range"]).join(labels, "label")
    # recall grows by one box with every hit and stays otherwise
    area = F.greatest("envelope", F.coalesce("later", F.lit(0.0))) / F.col("boxes")
    ap = run.groupBy(*key).agg(F.sum(area).alias("ap"))
    grid = labels.select("label", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    return grid.join(ap, key, "left").select("threshold", "label", F.coalesce("ap", F.lit(0.0)).alias("ap"))


#: The thresholds of the mean average precision, and that of a plain match.
IOUS, MATCH = tuple(x / 100 for x in range(50, 100, 5)), 0.5


def long_metrics(report: DataFrame, by: list[str] | None = None, suffix: str = "") -> DataFrame:
    """by..., metric, value: a report's columns as rows; nulls (metrics of empty slices) give none."""
    by = by or []
    columns = [c for c in report.columns if c not in by]
    rows = F.array(*[F.struct(F.lit(f"{c}{suffix}").alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return report.select(*by, F.explode(rows).alias("m")).select(*by, "m.metric", "m.value").filter("value is not null")


def mean_average_precision(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """metric, value: map_50_95 (mean over labels and IOUS), map_50, ap_50.<label>. Labels are those of the truth; without any, both means are 0."""
    ap = cut(average_precision(predictions, truth, list(IOUS)))  # a row per label and threshold, read three times
    means = ap.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map_50_95"), F.coalesce(F.avg(F.when(F.col("threshold") == MATCH, F.col("ap"))), F.lit(0.0)).alias("map_50"))
    return long_metrics(means).unionByName(ap.filter(F.col("threshold") == MATCH).select(F.concat(F.lit("ap_50."), F.col("label").cast("string")).alias("metric"), F.col("ap").alias("value")))


def matched_at_all(predictions: DataFrame, truth: DataFrame, threshold: float = MATCH) -> DataFrame:
    """Predictions with `matched`: whether any box of their image and label overlaps them enough."""
    t = truth.groupBy("image_id", "label").agg(F.collect_list("box").alias("boxes"))  # one image's boxes of one label
    near = predictions.join(t, ["image_id", "label"], "left")
    return near.withColumn("matched", F.coalesce(F.exists("boxes", lambda b: iou(b, F.col("box")) >= threshold), F.lit(False))).drop("boxes")


def detection_report(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """metric, value: those of mean_average_precision, the expected calibration error (ece) of the scores, and n_predictions."""
    bins = calibration(matched_at_all(predictions, truth), "score", "matched")
    error = bins.agg(F.coalesce(F.sum("gap"), F.lit(0.0)).alias("ece"))
    return mean_average_precision(predictions, truth).unionByName(long_metrics(error)).unionByName(long_metrics(predictions.agg(F.count("*").alias("n_predictions"))))


def numeric_report(answers: DataFrame, slices: dict[str, Column] | None = None) -> DataFrame:
    """metric, value: exact_match over what can be answered, answerable_n, refusal precision, recall, f1 and support, coverage_gap (the share of all
    questions whose figure exists but was not extracted), and exact_match.<slice>.

    answers (predicted, gold as printed text, scale_hint, not_disclosed, reason): a null prediction is a refusal. Nulls in
    not_disclosed count as disclosed; a slice without answerable rows gives no metric.
    """
    open_ = ~F.coalesce("not_disclosed", F.lit(False))
    right = numeric_match(F.col("predicted"), F.col("gold"), F.coalesce(F.col("scale_hint").cast("double"), F.lit(1.0))).cast("double")
    exact = F.avg(F.when(open_, right))
    gap = F.avg((~open_ & (F.coalesce("reason", F.lit("")) == "not-extracted")).cast("double"))
    each = {f"exact_match.{n}": F.avg(F.when(open_ & c, right)) for n, c in (slices or {}).items()}
    plain = answers.agg(F.coalesce(exact, F.lit(0.0)).alias("exact_match"), F.count_if(open_).alias("answerable_n"), gap.alias("coverage_gap"), *[c.alias(f"`{n}`".strip("`")) for n, c in each.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in plain.columns])
    plain = plain.select(F.explode(rows).alias("m")).select("m.*").filter("value is not null")
    refusal = binary_scores(answers.select((~open_).alias("truth"), F.col("predicted").isNull().alias("said")), "truth", "said").select(*[F.col(c).alias(f"refusal_{c}") for c in ("precision", "recall", "f1", "support")])
    return plain.unionByName(long_metrics(refusal))


def expected_route(tags: Column) -> Column:
    """The route that a question's tags imply: cross-modal before numeric before narrative."""
    return F.when(F.array_contains(tags, "cross-modal"), "cross_modal").when(F.array_contains(tags, "numeric"), "numeric").otherwise("narrative")


def routing_report(routes: DataFrame) -> DataFrame:
    """metric, value: accuracy, kappa and recall.<route> of routes (route, expected); routes that nothing expects have no recall."""
    right = (F.col("route") == F.col("expected")).cast("double")
    recall = routes.filter("expected is not null").groupBy("expected").agg(F.avg(F.coalesce(right, F.lit(0.0))).alias("value")).select(F.concat(F.lit("recall."), "expected").alias("metric"), "value")
    return long_metrics(routes.agg(F.avg(F.coalesce(right, F.lit(0.0))).alias("accuracy"))).unionByName(long_metrics(kappa(routes, "route", "expected").select("kappa"))).unionByName(recall)


def heldout_report(routes: DataFrame, expected: str = "numeric", leak: str = "narrative") -> DataFrame:
    """metric, value: accuracy and leaked_to_<leak> of routes of questions that all belong to one."""
    share_of = lambda r: F.avg(F.coalesce(F.col("route") == r, F.lit(False)).cast("double"))
    return long_metrics(routes.agg(share_of(expected).alias("accuracy"), share_of(leak).alias(f"leaked_to_{leak}")))


def dedupe_report(pairs: DataFrame, truth: str = "truth", said: str = "said", hard: Column | None = None) -> DataFrame:
    """metric, value: pair_precision, pair_recall, pair_f1, pair_support, accuracy, false_merge_rate (of all pairs), and accuracy.hard of the
    pairs that `hard` marks."""
    t, p = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(said), F.lit(False))
    scores = binary_scores(pairs, truth, said).select(*[F.col(c).alias(f"pair_{c}") for c in ("precision", "recall", "f1", "support")])
    plain = pairs.agg(F.avg((t == p).cast("double")).alias("accuracy"), F.avg((p & ~t).cast("double")).alias("false_merge_rate"))
    out = long_metrics(scores).unionByName(long_metrics(plain))
    return out if hard is None else out.unionByName(long_metrics(pairs.filter(hard).agg(F.avg((t == p).cast("double")).alias("accuracy")), suffix=".hard"))


def stage_diagnosis(gold: DataFrame, stages: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """query_id, one ndcg column per stage in the order given, delta (last less first): what each stage of retrieval does for each question."""
    out = gold.select("query_id").distinct()
    for name, ranking in stages.items():
        out = out.join(ranking_quality(gold, ranking, k).select("query_id", F.col("ndcg").alias(name)), "query_id")
    names = list(stages)
    return out.withColumn("delta", F.col(names[-1]) - F.col(names[0]))


def scored_comparison(gold: DataFrame, rankings: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """metric, value: <name>.ndcg@k and <name>.recall@k, means over the questions of `gold`."""
    parts = [long_metrics(ranking_quality(gold, r, k).agg(F.avg("ndcg").alias(f"{n}_ndcg"), F.avg("recall").alias(f"{n}_recall"))).withColumn("metric", F.regexp_replace("metric", r"^(.*)_(ndcg|recall)$", rf"$1.$2@{k}")) for n, r in rankings.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def arm_report(parities: dict[str, DataFrame]) -> DataFrame:
    """arm, queries, exact_order, top1_agreement, overlap, displacement, asymmetric_empty: means over questions of each arm's parity."""
    out = None
    for name, p in parities.items():
        one = p.agg(
            F.count("*").alias("queries"), F.avg(F.col("exact_order").cast("double")).alias("exact_order"), F.avg(F.col("top1").cast("double")).alias("top1_agreement"), F.avg("overlap").alias("overlap"),
            F.avg("displacement").alias("displacement"), F.count_if("one_empty").alias("asymmetric_empty"),
        ).select(F.lit(name).alias("arm"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def gate_results(metrics: DataFrame, baseline: DataFrame, gates: DataFrame) -> DataFrame:
    """metric, value, prior, verdict, passed: a missing metric fails, then floor, ceiling and regression are tested in this order.

    metrics (metric, value), baseline (metric, prior), gates (metric, min_value, max_value, max_regression, higher_is_better).
    """
    g = gates.join(metrics, "metric", "left").join(baseline, "metric", "left")
    worse = F.when(F.coalesce("higher_is_better", F.lit(True)), F.col("prior") - F.col("value")).otherwise(F.col("value") - F.col("prior"))
    verdict = (
        F.when(F.col("value").isNull(), "missing").when(F.col("value") < F.col("min_value"), "below floor").when(F.col("value") > F.col("max_value"), "above ceiling")
        .when(worse > F.col("max_regression"), "regressed").when(F.col("prior").isNull() & F.col("max_regression").isNotNull(), "no baseline yet").otherwise("ok")
    )
    return g.select("metric", "value", "prior", verdict.alias("verdict")).withColumn("passed", F.col("verdict").isin("ok", "no baseline yet"))
