"""Connected groups of pairwise matches by randomised graph contraction.

Each round draws a fresh hash order, every vertex hooks to the least of itself and its neighbours in that order, edges are
relabelled and deduplicated. Rounds end when no edge is left; the hooks of all rounds are then expanded backwards. Each round
shrinks the vertices that still have edges by a constant factor in expectation, whatever the shape of the graph, so a long
chain takes logarithmically many rounds. A hub's neighbours are only ever reduced by `min`, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut


def contract(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges (a bigint, b bigint), any direction, repeats and loops allowed -> (vertex, root), one row per vertex of an edge
    that is not a loop. Rows with a null end are ignored; no edges give no rows."""
    e = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    for round_ in range(most_rounds):
        if e.isEmpty():
            break
        order = lambda c, r=round_: F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("v"))
        both = e.select(F.col("a").alias("vertex"), order("b").alias("o")).unionByName(e.select(F.col("b").alias("vertex"), order("a").alias("o")))
        least = both.groupBy("vertex").agg(F.min("o").alias("o"))
        hook = cut(least.select("vertex", F.least(order("vertex"), F.col("o"))["v"].alias("to")))
        # the hooks of one round form trees; each vertex follows its own hook one step, the rest is left to later rounds
        hooks.append(hook)
        e = e.join(hook.withColumnsRenamed({"vertex": "a", "to": "ra"}), "a").join(hook.withColumnsRenamed({"vertex": "b", "to": "rb"}), "b")
        e = cut(e.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError("contraction did not end")
    if not hooks:
        return e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    found = hooks[-1].select("vertex", F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        # a vertex without a row in later rounds is a root already
        up = hook.join(found.withColumnsRenamed({"vertex": "to", "root": "upper"}), "to", "left")
        found = up.select("vertex", F.coalesce("upper", "to").alias("root"))
    return found


def match_groups(matches: DataFrame, reports: DataFrame) -> DataFrame:
    """report_id, group_id for every report in a group of two or more; group_id is the group's smallest report id.

    Point ids compare without letter case and outer blanks. A match with an end that is null or unknown, or both ends the same,
    links nothing.
    """
    key = lambda c: F.lower(F.regexp_replace(F.col(c), r"^[\s ]+|[\s ]+$", ""))
    ids = reports.select(key("point_id").alias("point"), F.col("id").alias("report_id")).filter("point is not null and report_id is not null")
    ends = matches.select(key("point_a").alias("pa"), key("point_b").alias("pb")).filter("pa is not null and pb is not null").distinct()
    edges = ends.join(ids.withColumnsRenamed({"point": "pa", "report_id": "a"}), "pa").join(ids.withColumnsRenamed({"point": "pb", "report_id": "b"}), "pb")
    roots = cut(contract(edges.select("a", "b")))
    least = roots.groupBy("root").agg(F.min("vertex").alias("least"))
    group = F.least("least", "root")
    members = roots.join(least, "root").select(F.col("vertex").alias("report_id"), group.alias("group_id"))
    return members.distinct()
