"""Graph projections by level-synchronous joins: traversals, components, lineage, shortest typed walks.

Every loop writes its level to the shared folder, so plans stay small and a lost executor costs one level.
Minima and distinct combine before the shuffle; no node's neighbours are gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workledger.functions.ids import ref
from workledger.schema import SUPPORTING
from workledger.shared import freed, in_order, skew_join, written

MAX_ROUNDS = 60


def crosswalk_edges(crosswalks: DataFrame) -> DataFrame:
    """Both directions of current identity links."""
    left, right = ref(F.col("left_ns"), "left_val"), ref(F.col("right_ns"), "right_val")
    one = crosswalks.select(left.alias("source"), right.alias("target"), "link_id", "record_id", "evidence_event_ids")
    both = one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "link_id", "record_id", "evidence_event_ids"))
    return both.select(
        "source", "target", F.lit("crosswalk").alias("kind"), F.col("link_id").alias("edge_id"),
        F.col("record_id").alias("revision_id"), F.lit(None).cast("string").alias("predicate"),
        F.lit("association").alias("direction"), "evidence_event_ids", F.lit(False).alias("establishes"),
    )


def supports(df: DataFrame) -> DataFrame:
    """Marks relations whose predicate and end namespaces may carry attribution."""
    table = df.sparkSession.createDataFrame(list(SUPPORTING), "predicate string, subject_ns string, object_ns string")
    marked = F.broadcast(table.withColumn("__yes", F.lit(True)))
    return df.join(marked, ["predicate", "subject_ns", "object_ns"], "left").withColumn("establishes", F.coalesce("__yes", F.lit(False))).drop("__yes")


def relation_edges(relations: DataFrame) -> DataFrame:
    """Both directions of current relations."""
    subject, object_ = ref(F.col("subject_ns"), "subject_val"), ref(F.col("object_ns"), "object_val")
    rows = supports(relations)
    out = None
    for source, target, way in ((subject, object_, "forward"), (object_, subject, "reverse")):
        part = rows.select(
            source.alias("source"), target.alias("target"), F.lit("relation").alias("kind"),
            F.col("relation_id").alias("edge_id"), F.col("record_id").alias("revision_id"), "predicate",
            F.lit(way).alias("direction"), "evidence_event_ids", "establishes",
        )
        out = part if out is None else out.unionByName(part)
    return out


def attempt_edges(outcomes: DataFrame) -> DataFrame:
    """One-way edges from a job to its attempts, from outcome events."""
    return outcomes.where("outcome_type = 'fab.attempt' and reference is not null").select(
        ref("fab.job", "reference").alias("source"), ref("fab.attempt", "native_id").alias("target"),
        F.lit("event").alias("kind"), F.col("event_id").alias("edge_id"), F.lit(None).cast("string").alias("revision_id"),
        F.lit("attempt_of").alias("predicate"), F.lit("forward").alias("direction"),
        F.array("event_id").alias("evidence_event_ids"), F.lit(False).alias("establishes"),
    )


def attribution_graph(crosswalks: DataFrame, relations: DataFrame, outcomes: DataFrame) -> DataFrame:
    return crosswalk_edges(crosswalks).unionByName(relation_edges(relations)).unionByName(attempt_edges(outcomes))


def reachable(roots: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """``(root, node)`` and ``(source, target)`` -> ``root, node, depth``, depth of first arrival, up to a bound."""
    steps = written(edges.select("source", "target").distinct(), "steps")
    levels = [written(roots.select("root", "node").distinct().withColumn("depth", F.lit(0)), "frontier")]
    for depth in range(1, max_depth + 1):
        moved = levels[-1].join(steps, levels[-1]["node"] == steps["source"]).select("root", F.col("target").alias("node")).distinct()
        levels.append(written(moved.join(_all(levels), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier"))
        if levels[-1].isEmpty():
            break
    freed(steps)
    return _held(_all(levels), levels)


def traverse(root: DataFrame, relations: DataFrame, direction: str = "both", max_depth: int = 4, predicates: list[str] | None = None) -> DataFrame:
    """Depth-bounded walk over relations, outgoing, incoming or both, by chosen predicates."""
    edges = relation_edges(relations)
    if predicates is not None:
        edges = edges.where(F.col("predicate").isin(predicates))
    if direction != "both":
        edges = edges.where(F.col("direction") == ("forward" if direction == "outgoing" else "reverse"))
    return reachable(root, edges, max_depth)


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links -> ``node, root``, the smallest node connected; alternating large and small stars."""
    edges = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    sign = [F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")]
    before = tuple(edges.agg(*sign).head())
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        up = skew_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = up.union(least.where("a <> m")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(large, lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.union(lower).distinct(), "links")
        now = tuple(edges.agg(*sign).head())
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def event_families(events: DataFrame) -> DataFrame:
    """``event_id, session_id, parent_event_id`` -> ``node, root``: ids joined by ancestry, missing parents too."""
    links = events.select(F.col("event_id").alias("a"), F.col("session_id").alias("b")).unionByName(
        events.select(F.col("event_id").alias("a"), F.col("parent_event_id").alias("b"))
    )
    ids = events.select(F.col("event_id").alias("node"))
    for c in ("session_id", "parent_event_id"):
        ids = ids.union(events.where(F.col(c).isNotNull()).select(F.col(c).alias("node")))
    return skew_join(ids.distinct(), components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def family_closure(seeds: DataFrame, events: DataFrame) -> DataFrame:
    """``(root, node)`` -> ``root, node`` of every id in the families of a root's seeds: up and down ancestry, through sessions
    and through parents that are not stored.

    The search starts from what is asked and each level takes only ids that are new to their root, so what no
    root asks for is never walked; a session of very many events is split among tasks.
    """
    up = F.array_compact(F.array("parent_event_id", "session_id"))
    one = events.select(F.col("event_id").alias("node"), F.explode(up).alias("other")).where("node <> other").distinct()
    ways = written(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))), "ancestry")
    seen = frontier = written(seeds.select("root", "node").distinct(), "family")
    while not frontier.isEmpty():
        moved = skew_join(frontier, ways, "node").select("root", F.col("other").alias("node")).distinct()
        frontier = written(moved.join(seen, ["root", "node"], "left_anti"), "family")
        seen = seen.unionByName(frontier)
    return seen


def lineage(costs: DataFrame, events: DataFrame) -> DataFrame:
    """``(event_id, parent_event_id, session_id)`` costs -> ``cost_id, event_id`` of every stored ancestor.

    Each round goes twice as far as the one before, so chains of n ancestors take log n rounds; a cycle ends where
    nothing is new.
    """
    known = events.select("event_id")
    exploded = events.select("event_id", F.explode(F.array_compact(F.array("parent_event_id", "session_id"))).alias("up"))
    ups = written(exploded.join(known.select(F.col("event_id").alias("up")), "up", "left_semi").select("event_id", "up"), "ups")
    start = costs.select(
        F.col("event_id").alias("cost_id"), F.explode(F.array_compact(F.array("parent_event_id", "session_id"))).alias("event_id")
    ).where("cost_id <> event_id")
    levels = [written(start.distinct().join(known, "event_id", "left_semi").select("cost_id", "event_id"), "lineage")]
    while True:  # ``ups`` leads up a power of two, and ``levels`` hold all that is at most as far from a cost
        seen = _all(levels)
        moved = seen.join(ups, "event_id").select("cost_id", F.col("up").alias("event_id")).where("cost_id <> event_id").distinct()
        levels.append(written(moved.join(seen, ["cost_id", "event_id"], "left_anti"), "lineage"))
        if levels[-1].isEmpty():
            break
        further = ups.join(ups.select(F.col("event_id").alias("up"), F.col("up").alias("next")), "up").select("event_id", F.col("next").alias("up"))
        further = written(further.distinct(), "ups")
        freed(ups)
        ups = further
    freed(ups)
    return _held(_all(levels), levels)


#: What a step of a walk is shown as.
STEP = ("kind", "source", "target", "edge_id", "revision_id", "predicate", "direction", "evidence_event_ids")


def placed_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with ``edge``, their number in the order (target, kind, edge_id, direction, source)."""
    rows = edges.select(*STEP, "establishes")
    order = ("target", "kind", "edge_id", "direction", "source")
    placed = in_order(rows, "edges", *order)
    out = written(placed.withColumnRenamed("place", "edge"), "placed-edges")
    freed(placed)
    return out


def arrivals(roots: DataFrame, edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """``walks`` over edges without numbers: the same ``start, node, used, depth``, and null for each ``path``.

    Whether a walk arrives does not depend on which of several equal ones is shown, so ends of edges are all that is kept.
    """
    steps = written(edges.select(F.col("source").alias("node"), "target", "establishes").distinct(), "steps")
    levels = [written(roots.select("start", "node", F.lit(False).alias("used"), F.lit(0).alias("depth")).distinct(), "walks")]
    for depth in range(1, max_depth + 1):
        moved = skew_join(levels[-1], steps, "node").select("start", F.col("target").alias("node"), (F.col("used") | F.col("establishes")).alias("used"))
        fresh = moved.distinct().join(_all(levels).select("start", "node", "used"), ["start", "node", "used"], "left_anti")
        levels.append(written(fresh.withColumn("depth", F.lit(depth)), "walks"))
        if levels[-1].isEmpty():
            break
    freed(steps)
    return _held(_all(levels).withColumn("path", F.lit(None).cast("array<long>")), levels)


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _held(df: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``df`` with the written frames that it reads, which a caller may free once it is done."""
    df.levels = levels
    return df


def walks(roots: DataFrame, placed: DataFrame, max_depth: int = 8) -> DataFrame:
    """``(start, node)`` over ``placed_edges`` -> ``start, node, used, depth, path`` of the first walk to each (node, used).

    ``used`` tells whether the walk has passed an edge that establishes a relation. Among walks of equal
    length the first in the order of breadth-first search from sorted roots over sorted edges is kept: that of the
    smallest ``path``, the root's number and those of the edges. So the search carries a long a step, and nothing is
    ranked between levels; ``steps_of`` says what the numbers stand for.
    """
    fewest = placed.groupBy("source", "target", "establishes").agg(F.min("edge").alias("edge"))
    steps = written(fewest.withColumnRenamed("source", "node"), "steps")
    numbers = in_order(roots.select("node").distinct(), "roots", "node")
    first = skew_join(roots.select("start", "node").distinct(), numbers, "node")
    levels = [written(first.select("start", "node", F.lit(False).alias("used"), F.lit(0).alias("depth"), F.array("place").alias("path")), "walks")]
    freed(numbers)
    for depth in range(1, max_depth + 1):
        moved = skew_join(levels[-1], steps, "node").select(
            "start", F.col("target").alias("node"), (F.col("used") | F.col("establishes")).alias("used"), F.array_append("path", F.col("edge")).alias("path")
        )
        # the first walk of each arrival is taken before what was seen, as it combines before the shuffle
        best = moved.groupBy("start", "node", "used").agg(F.min("path").alias("path"))
        fresh = best.join(_all(levels).select("start", "node", "used"), ["start", "node", "used"], "left_anti")
        levels.append(written(fresh.select("start", "node", "used", F.lit(depth).alias("depth"), "path"), "walks"))
        if levels[-1].isEmpty():
            break
    freed(steps)
    return _held(_all(levels), levels)


def steps_of(paths: DataFrame, placed: DataFrame) -> DataFrame:
    """``path`` -> ``path, steps`` of each distinct one, its edges in order; a path is at most as long as the search is deep."""
    distinct = paths.select("path").distinct()
    edges = placed.select(F.col("edge"), F.struct(*STEP).alias("step"))
    passed = distinct.where(F.size("path") > 1).select("path", F.posexplode(F.slice("path", F.lit(2), F.size("path") - 1)).alias("at", "edge"))
    rows = skew_join(passed, edges, "edge").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "step"))).alias("rows"))
    none = F.filter(F.array(F.struct(*(F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in STEP))), lambda x: F.lit(False))
    return distinct.join(rows, "path", "left").select("path", F.coalesce(F.transform("rows", lambda r: r["step"]), none).alias("steps"))
