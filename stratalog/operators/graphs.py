"""Questions on graphs of any size: cycles, chains upward, components peeled in rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it names none and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its size is known to later joins, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/stratalog/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges of a graph, or of a connected part of one, that one task takes by itself.
SMALL = 100_000
#: Layers of dead ends that are taken off a larger graph; leaving some in changes no result.
LAYERS = 8


def _plain(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) but for loops."""
    return cut_lineage(edges.select("a", "b").filter("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, part): the least node of each node's weakly connected part.

    A round moves every node to its least neighbour, first from the larger ends of its edges, then from
    the smaller; a path halves with each, so a ring of n nodes takes about log2(n) rounds.
    """
    now, seen = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    while True:
        check = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (check.n, check.x) == seen or not check.n:
            break
        seen = (check.n, check.x)
        both = now.union(now.select("v", "u"))
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        large = cut_lineage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.filter("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("part")).union(now.select(F.col("v").alias("node"), F.col("v").alias("part"))).groupBy("node").agg(F.min("part").alias("part"))


def _circular(edges: pd.DataFrame) -> list:
    """Nodes on cycles of a small graph: those of strongly connected components of several nodes, by Tarjan's walk with a stack of its own."""
    nexts = edges.groupby("a")["b"].agg(list).to_dict()
    index, low, open_, held, found = {}, {}, [], set(), []
    for start in nexts:
        if start in index:
            continue
        trail = [(start, iter(nexts[start]))]
        index[start] = low[start] = len(index)
        open_.append(start)
        held.add(start)
        while trail:
            node, rest = trail[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    open_.append(nxt)
                    held.add(nxt)
                    trail.append((nxt, iter(nexts.get(nxt, ()))))
                    break
                if nxt in held:
                    low[node] = min(low[node], index[nxt])
            else:
                trail.pop()
                if trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
                if low[node] == index[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(open_.pop())
                    held.difference_update(own)
                    if len(own) > 1:
                        found += own
    return found


def _trimmed(core: DataFrame) -> DataFrame:
    """Edges that are left when up to LAYERS layers of dead ends, in both directions, are taken off."""
    n = core.count()
    for _ in range(LAYERS):
        ends, starts = core.select(F.col("b").alias("a")).distinct(), core.select(F.col("a").alias("b")).distinct()
        core = cut_lineage(core.join(starts, "b", "left_semi").join(ends, "a", "left_semi").select("a", "b"))
        left = core.count()
        if left == n:
            break
        n = left
    return core


def _doubled(step: DataFrame, inner: DataFrame) -> DataFrame:
    """(node, to) of nodes with one way on: ``to`` is where the way leaves them, or still one of them on a ring of nothing else."""
    now = cut_lineage(step)
    for _ in range(now.count().bit_length() + 1):
        over = now.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        now = cut_lineage(now.join(over, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
        if not now.filter("moved").take(1):
            break
        now = now.drop("moved")
    return now.select("node", "to").join(inner.select(F.col("node").alias("to"), F.lit(True).alias("ring")), "to", "left")


def _large_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on cycles of a graph of any size.

    Runs of nodes with one way in and one way on are passed over by pointer doubling, so what is left to
    rounds of one hop are the branching nodes; a run lies on a cycle if its two ends do together, and a ring of nothing else
    is one. Then forward and backward colouring: each node takes the least node that reaches it; what in turn
    reaches that node within its colour lies on a cycle with it. Those nodes go, and so on until nothing is left.
    """
    out = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("to"))
    into = edges.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("of"))
    one = out.filter("n = 1").select(F.col("a").alias("node"), "to").join(into.filter("n = 1").select(F.col("b").alias("node"), "of"), "node")
    one = cut_lineage(one)
    ahead = cut_lineage(_doubled(one.select("node", "to"), one))
    back = _doubled(one.select("node", F.col("of").alias("to")), one).select("node", F.col("to").alias("of"))
    found = [ahead.filter("ring").select("node")]
    passed = ahead.filter("ring is null").select("node", "to")
    outer = edges.join(one.select(F.col("node").alias("a")), "a", "left_anti").join(passed.select(F.col("node").alias("b"), "to"), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
    outer = cut_lineage(outer.distinct())
    loops = outer.filter("a = b").select(F.col("a").alias("node"))
    core, coloured = _trimmed(outer.filter("a <> b")), [loops.select("node", F.col("node").alias("colour"))]
    while core.take(1):
        nodes = core.select(F.col("a").alias("node")).union(core.select(F.col("b").alias("node"))).distinct()
        colour = _spread(nodes.withColumn("label", F.col("node")), core)
        own = core.join(colour.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b")
        turned = cut_lineage(own.filter("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")))
        # backward from each colour's own node, within the colour: a label that stays null is not reached
        start = colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label"))
        reached = cut_lineage(_reach(start, turned).filter("label is not null").select("node", F.col("label").alias("colour")))
        coloured.append(reached.join(turned.select(F.col("a").alias("node")).distinct(), "node", "left_semi"))
        gone = reached.select(F.col("node").alias("a"))
        core = _trimmed(cut_lineage(core.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti")))
    marks = cut_lineage(reduce(DataFrame.union, coloured).groupBy("node").agg(F.collect_set("colour").alias("colours")))  # its own, and that of its part
    ends = passed.join(back, "node").join(marks.select(F.col("node").alias("to"), F.col("colours").alias("x")), "to").join(marks.select(F.col("node").alias("of"), F.col("colours").alias("y")), "of")
    found += [marks.select("node"), ends.filter((F.col("to") == F.col("of")) | F.arrays_overlap("x", "y")).select("node")]
    return reduce(DataFrame.union, found).distinct()


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves over edges other than loops.

    A graph of up to SMALL edges is one task's work; of a larger one, so is each connected part of that
    size. Only parts beyond it take rounds of joins (``_large_cycles``).
    """
    core = _plain(edges)
    kind, n = T.StructType([T.StructField("node", core.schema["a"].dataType)]), core.count()
    if n <= SMALL:
        return core.coalesce(1).mapInPandas(_circular_of(kind), kind) if n else edges.select(F.col("a").alias("node")).limit(0)
    core = _trimmed(core)
    parted = cut_lineage(core.join(components(core), F.col("a") == F.col("node")).drop("node"))
    size = parted.groupBy("part").agg(F.count("*").alias("n"))
    small = parted.join(size.filter(F.col("n") <= SMALL), "part").groupBy("part").applyInPandas(lambda rows: pd.DataFrame({"node": _circular(rows)}).astype({"node": rows["a"].dtype}), kind)
    large = cut_lineage(parted.join(size.filter(F.col("n") > SMALL), "part").select("a", "b"))
    return small.union(_large_cycles(large)).distinct() if large.take(1) else small


def _circular_of(kind: T.StructType):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            edges = pd.concat(held)
            yield pd.DataFrame({"node": _circular(edges)}).astype({"node": edges["a"].dtype})

    return run


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with each label lowered to the least that reaches the node along the edges, in rounds."""
    now = cut_lineage(labels)
    while True:
        near = edges.join(now, edges["a"] == now["node"]).groupBy("b").agg(F.min("label").alias("least"))
        moved = cut_lineage(now.join(near, now["node"] == near["b"], "left").select("node", F.least("label", "least").alias("label"), (F.col("least") < F.col("label")).alias("fell")))
        if not moved.filter("fell").take(1):
            return now
        now = moved.drop("fell")


def _reach(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): a null label is filled by the one that reaches the node along the edges, in rounds."""
    now = cut_lineage(labels)
    while True:
        near = edges.join(now.filter("label is not null"), edges["a"] == now["node"]).groupBy("b").agg(F.min("label").alias("least"))
        moved = cut_lineage(now.join(near, now["node"] == near["b"], "left").select("node", F.coalesce("label", "least").alias("label"), (F.col("label").isNull() & F.col("least").isNotNull()).alias("filled")))
        if not moved.filter("filled").take(1):
            return now
        now = moved.drop("filled")


def cycle_paths(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(path) of each edge that closes a cycle in a depth-first walk, as ``a -> b -> a``.

    ``edges`` (a, b, pos) and ``order`` (node, ord) fix the walk. Where it enters a cycle depends on what
    leads there, so each weakly connected part that has a cycle is walked whole, in one task; a graph of up to
    SMALL edges in one.
    """
    rows = cut_lineage(edges.filter("a <> b").groupBy("a", "b").agg(F.min("pos").alias("pos")).join(order.select(F.col("node").alias("a"), "ord"), "a"))
    if rows.count() <= SMALL:
        return rows.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_walk, "path string")
    part = components(rows)
    held = part.join(on_cycle(rows), "node", "left_semi").select("part").distinct()
    kept = part.join(held, "part", "left_semi").select(F.col("node").alias("a"), "part")
    return rows.join(kept, "a").groupBy("part").applyInPandas(_walk, "path string")


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    nexts = rows.sort_values(["pos", "b"]).groupby("a")["b"].agg(list).to_dict()  # one sort: one for each node takes a millisecond a node
    starts = rows.sort_values(["ord", "a"])["a"].drop_duplicates().tolist()
    done, found = set(), []
    for start in starts:
        if start in done:
            continue
        trail, place = [(start, iter(nexts.get(start, [])))], {start: 0}
        while trail:
            node, rest = trail[-1]
            nxt = next(rest, None)
            if nxt is None:
                trail.pop()
                done.add(node)
                del place[node]
            elif nxt in place:
                names = [n for n, _ in trail[place[nxt] :]] + [nxt]
                found.append(" -> ".join(map(str, names)))
            elif nxt not in done:
                place[nxt] = len(trail)
                trail.append((nxt, iter(nexts.get(nxt, []))))
    return pd.DataFrame({"path": pd.Series(found, dtype=str)})


def chain_levels(parents: DataFrame) -> DataFrame:
    """(node, top, levels): where each node's chain of parents ends, and how many steps up that is.

    ``parents`` (node, parent) has a null parent at the top. Pointers double with each round, so
    a chain of length n takes log2(n) rounds. Nodes whose chain runs into a cycle have no top.
    """
    now = cut_lineage(parents.select("node", F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("levels")))
    n = now.count()
    for _ in range(max(1, n.bit_length() + 1)):
        up = now.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("levels").alias("_more"))
        moved = cut_lineage(now.join(up, "top", "left").select("node", F.coalesce("_top", "top").alias("top"), (F.col("levels") + F.coalesce("_more", F.lit(0))).alias("levels"), (F.coalesce("_more", F.lit(0)) > 0).alias("_moved")))
        now = moved.drop("_moved")
        if not moved.filter("_moved").take(1):
            break
    tops = parents.filter("parent is null").select(F.col("node").alias("top"))
    outside = parents.join(parents.select(F.col("node").alias("parent")), "parent", "left_anti").filter("parent is not null").select(F.col("parent").alias("top")).distinct()
    return now.join(tops.union(outside).distinct(), "top", "left_semi").select("node", "top", "levels")


def chain_search(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, depth, labels, shared, terminal): all that is reached upward from labelled starts, each at its least depth.

    ``starts`` (label, node, ord), ``parents`` (node, parent), the parent null, or the node not there, at
    the top. A start has the labels that name it, in their order; more than one make it shared. Where a
    top was reached, a last row (node null) stands one level deeper than all others. Round k adds what
    lies 2**k steps above, so a chain of length n takes log2(n) rounds; a cycle ends when nothing new or
    less deep is found.
    """
    held = cut_lineage(starts.select("label", "node", "ord"))
    up = cut_lineage(parents.filter("parent is not null").select("node", F.col("parent").alias("top")))
    labels = held.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("labels"))
    found, step = cut_lineage(held.select("node", F.lit(0).cast("long").alias("depth")).distinct()), 1
    while True:
        above = found.join(up, "node").select(F.col("top").alias("node"), (F.col("depth") + step).alias("depth"), F.lit(True).alias("new"))
        both = found.withColumn("new", F.lit(False)).unionByName(above).groupBy("node").agg(F.min("depth").alias("depth"), F.min_by("new", F.struct("depth", "new")).alias("new"))
        now = cut_lineage(both)
        if not now.filter("new").take(1):
            break
        found, step = now.drop("new"), step * 2
        over = up.select(F.col("node").alias("top"), F.col("top").alias("_top"))
        up = cut_lineage(up.join(over, "top").select("node", F.col("_top").alias("top")))
    levels = found.join(labels, "node", "left").select("node", "depth", F.coalesce("labels", F.array().cast(labels.schema["labels"].dataType)).alias("labels"))
    levels = cut_lineage(levels.select("*", (F.size("labels") > 1).alias("shared"), F.lit(False).alias("terminal")))
    tops = levels.join(parents.filter("parent is not null").select("node"), "node", "left_anti").agg(F.count("*").alias("n"))
    none = F.lit(None)
    last = levels.agg((F.max("depth") + 1).alias("depth")).join(F.broadcast(tops)).filter("n > 0").select(none.cast(levels.schema["node"].dataType).alias("node"), "depth", F.array().cast(levels.schema["labels"].dataType).alias("labels"), F.lit(False).alias("shared"), F.lit(True).alias("terminal"))
    return levels.unionByName(last)


def chain_summary(levels: DataFrame) -> DataFrame:
    """(starting_points, distinct_starts, shared_starts) of a search."""
    n = F.size("labels").cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return levels.agg(total(n).alias("starting_points"), F.count_if(n > 0).alias("distinct_starts"), total(F.when(F.col("shared"), n)).alias("shared_starts"))


def roll_over(records: DataFrame, shard: str, order: str, size: str, budget: int) -> DataFrame:
    """Part of each record in its shard: a part takes whole records until it holds ``budget``, then the next begins.

    The count restarts from zero, so no running sum gives it. Each task streams its shards in order
    and holds one batch, whatever a shard's size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, part, held = None, 0, 0
        for batch in batches:
            parts = []
            for key, n in zip(batch[shard], batch[size], strict=True):
                if key != last:
                    last, part, held = key, 0, 0
                parts.append(part)
                held += n
                if held >= budget:
                    part, held = part + 1, 0
            yield batch.assign(part=pd.Series(parts, dtype="int64", index=batch.index))

    rows = records.select(shard, order, size).repartition(shard).sortWithinPartitions(shard, order)
    return rows.mapInPandas(run, T.StructType([*rows.schema, T.StructField("part", T.LongType())]))
