"""The forest of sessions under their parents (G1-G5, J10): pointer doubling with joins, stored by the round."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.sources.shared import remove_folder, stored

MOST_NODES = 1000


def normalized(sessions: DataFrame) -> DataFrame:
    """G1: (id, parent, self_parent, orphan): a session that is its own parent, or whose parent is gone, is a root."""
    known = sessions.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    rows = sessions.select("id", "parent_id").join(known, "parent_id", "left")
    own = F.coalesce(F.col("parent_id") == F.col("id"), F.lit(False))
    orphan = F.col("parent_id").isNotNull() & F.col("known").isNull()
    return rows.select("id", F.when(~own & ~orphan, F.col("parent_id")).alias("parent"), own.alias("self_parent"), orphan.alias("orphan"))


def leading_to_cycles(nodes: DataFrame) -> DataFrame:
    """(id, least, far): sessions that lead into a cycle of parents, the least id of the cycle, and one on the cycle that they reach; each session on a cycle is reached so.

    Doubling: a round knows the session that is 2 ** k above and the least id on the way there; who has none so far up
    is left out. Who finds its own id as the least one on its way is on a cycle, and names it. Rounds end when all that
    are left pass such a session in the second half of their way: with the logarithm of the longest way into a cycle or
    around one, however many sessions there are.
    """
    spark = nodes.sparkSession
    now, path = stored(nodes.where("parent is not null").select("id", F.col("parent").alias("to"), F.col("parent").alias("least")))
    while True:
        above = now.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("least").alias("further"))
        after, newer = stored(now.join(above, "to").select("id", "far", "least", "further"))
        remove_folder(spark, path)
        names = after.where("least = id").select(F.col("id").alias("further"))
        if after.join(names, "further", "left_anti").isEmpty():
            return after.select("id", F.col("further").alias("least"), "far")
        now, path = after.select("id", F.col("far").alias("to"), F.least("least", "further").alias("least")), newer


def _entries(nodes: DataFrame, led: DataFrame, on_cycle: DataFrame) -> DataFrame:
    """(id, e): for each session that leads into a cycle the first one on the cycle, by doubling; on a cycle it is the session itself."""
    marked = led.select("id").join(nodes, "id").join(on_cycle.withColumn("there", F.lit(True)), "id", "left")
    now, path = stored(marked.select("id", F.when(F.col("there"), F.col("id")).otherwise(F.col("parent")).alias("to"), F.coalesce("there", F.lit(False)).alias("there")))
    while not now.where("not there").isEmpty():
        above = now.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("there").alias("far_there"))
        now, newer = stored(now.join(above, "to").select("id", F.col("far").alias("to"), F.col("far_there").alias("there")))
        remove_folder(nodes.sparkSession, path)
        path = newer
    return now.select("id", F.col("to").alias("e"))


def forest(nodes: DataFrame) -> DataFrame:
    """(id, parent, cut) without cycles, stored.

    As if walks to the root began at the ids in order: the walk from the least id that leads into a cycle
    enters it at e, and the edge that closes it, of the session whose parent is e, is cut.
    """
    nodes, _ = stored(nodes.select("id", "parent"))
    led = leading_to_cycles(nodes)
    if led.isEmpty():
        return nodes.select("id", "parent", F.lit(False).alias("cut"))
    on_cycle = led.select(F.col("far").alias("id")).distinct()
    first = led.groupBy("least").agg(F.min("id").alias("id"))
    entered = _entries(nodes, led, on_cycle).join(first, "id", "left_semi").select(F.col("e").alias("parent"))
    cut = nodes.join(on_cycle, "id", "left_semi").join(entered, "parent", "left_semi").select("id", F.lit(True).alias("cut"))
    return stored(nodes.join(cut, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), F.coalesce("cut", F.lit(False)).alias("cut")))[0]


def sums_along(trees: DataFrame, value: Column, start: Column) -> DataFrame:
    """(id, up, down): `value` summed over a session and all above it, `start` over it and all below it.

    Doubling: a round takes in the next 2 ** k levels, from the session that far above (up) and from those that far
    below (down). A session has one pointer, so that a round moves each row once, whatever the depth of its tree.
    """
    now, path = stored(trees.select("id", F.col("parent").alias("to"), value.cast("long").alias("up"), start.cast("long").alias("down")))
    while not now.where("to is not null").isEmpty():
        above = now.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("up").alias("more_up"))
        below = now.where("to is not null").groupBy(F.col("to").alias("id")).agg(F.sum("down").alias("more_down"))
        sums = now.join(above, "to", "left").join(below, "id", "left").na.fill(0, ["more_up", "more_down"])
        now, newer = stored(sums.select("id", F.col("far").alias("to"), (F.col("up") + F.col("more_up")).alias("up"), (F.col("down") + F.col("more_down")).alias("down")))
        remove_folder(trees.sparkSession, path)
        path = newer
    return now.select("id", "up", "down")


def lineage(trees: DataFrame) -> DataFrame:
    """(id, parent, depth, subtree_size, children); depth 0 is a root, a subtree has its root."""
    sums = sums_along(trees, F.col("parent").isNotNull().cast("int"), F.lit(1))
    children = trees.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    sized = trees.select("id", "parent").join(sums, "id").join(children, "id", "left").na.fill(0, ["children"])
    return sized.select("id", "parent", F.col("up").cast("int").alias("depth"), F.col("down").alias("subtree_size"), "children")


def lineage_summary(nodes: DataFrame, trees: DataFrame, shape: DataFrame) -> DataFrame:
    """G1-G3 in one row: sessions, roots, children, max_depth, self parents, orphans, edges cut."""
    counted = nodes.agg(F.count("*").alias("sessions"), F.count_if("self_parent").alias("self_parents"), F.count_if("orphan").alias("orphans"))
    cut = trees.agg(F.count_if("cut").alias("cycles_cut"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if(F.col("parent").isNotNull()).alias("children"))
    return counted.crossJoin(cut).crossJoin(shape.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth")))  # one row each


def focus(trees: DataFrame, shape: DataFrame, id_: str) -> DataFrame:
    """Of the shape, a session with all above and below it; all where there is no such session."""
    own = (F.col("id") == id_).cast("int")
    near = sums_along(trees, own, own).where("up + down > 0").select("id")
    return shape if near.isEmpty() else shape.join(near, "id", "left_semi")


def lineage_graph(shape: DataFrame, budget: int = 400) -> DataFrame:
    """The sessions that a breadth-first walk takes first, up to the budget: roots and children by subtree size, then id.

    (id, parent, position, depth, subtree_size, omitted). Sizes of levels tell which levels are taken whole: they have
    fewer sessions than the budget, at most 1000, and are put in order by themselves. Of the level after them the first
    ones are one top-k by their parents' places. So many jobs there are, however deep the forest is.
    """
    budget = max(1, min(budget, MOST_NODES))
    shape, _ = stored(shape.select("id", "parent", "depth", "subtree_size"))  # read by each of the jobs
    spark, total = shape.sparkSession, shape.count()
    # a level has one session at least, so that no more levels than the budget are reached
    widths = {r.depth: r["count"] for r in shape.where(F.col("depth") < budget).groupBy("depth").count().collect()}
    last, above = 0, 0
    while last in widths and above + widths[last] <= budget:
        above, last = above + widths[last], last + 1
    whole = shape.where(F.col("depth") < last).select("id", "parent", "depth", "subtree_size").collect() if last else []
    levels, place = defaultdict(list), {}
    for r in whole:
        levels[r.depth].append(r)
    for depth in range(last):
        for r in sorted(levels[depth], key=lambda r: (place[r.parent] if depth else 0, -r.subtree_size, r.id.encode())):
            place[r.id] = len(place)
    taken = list(place.items())
    if above < budget and last in widths:
        level = shape.where(F.col("depth") == last)
        if last:
            level = level.join(F.broadcast(spark.createDataFrame(taken, "parent string, place int")), "parent")
        else:
            level = level.withColumn("place", F.lit(0))
        rest = level.orderBy("place", F.desc("subtree_size"), "id").limit(budget - above).select("id").collect()
        taken += [(r.id, above + i) for i, r in enumerate(rest)]
    chosen = spark.createDataFrame(taken, "id string, position int")
    return shape.join(F.broadcast(chosen), "id").select("id", "parent", "position", "depth", "subtree_size", F.lit(total - len(taken)).cast("long").alias("omitted")).orderBy("position")


def lineage_edges(graph: DataFrame) -> DataFrame:
    """(parent, id) between sessions that are both taken."""
    return graph.select("id", "parent").join(graph.select(F.col("id").alias("parent")), "parent", "left_semi").select("parent", "id").orderBy("parent", "id")
