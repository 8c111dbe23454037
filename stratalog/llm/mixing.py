"""Operator 3: mixing sources to target weights, with DataFrame operations only.

The words of each source, its documents one after the other, are packed into blocks of
``block_words`` words. Targets share the wanted total by weight, none above ``most`` times its
source. A source takes as many slots as its target fills: whole passes over its blocks, then a
part of one, of which the last slot may be cut, so that it meets its target to the word.

Each shard's source counts are multinomial given the sources' totals, as if every slot were thrown by
itself: the shards are the leaves of a binary tree, and at each node a source's slots go left by a fair
coin each, of which 64 are the bits of one hash. The work is a hash for 64 slots and a row for each
node; nothing is shuffled but the coins of nodes with over ``COINS`` slots. A shard's slots of a source then are a run of that source's slot
numbers; a pseudorandom permutation of the source's block numbers, another for each pass, maps
them to blocks, and slots and documents meet by (source, block). The permutation is a Feistel
network on a grid that barely exceeds the number of blocks; a number that leaves the range walks
on along its cycle, so it is one to one.

Scale: documents are numbered within (source, hash bucket), never within a whole source; the
number of buckets follows the number of rows, so nothing hangs on a setting of the cluster. The
slots of a source are made shard by shard, so a source with a third of all rows is spread over all
tasks. Slots and fragments, each made many to a row, meet by a merge join whatever their estimated
size. Windows without such buckets run over sources, over buckets of a source (a row for
``BUCKET_ROWS`` documents) or over groups of a source's shards (a row for ``SHARD_GROUP`` shards).

Edge cases: a null text has size 0; a null source is a source of its own, after all others; a
source without words has target 0; rows that repeat or have null ids count one by one, in an order
of their contents; an empty table gives an empty result. A document of no words takes none. Other
columns are carried by ``mix_documents`` and otherwise ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import fresh, partitions, staged, with_key, with_length

WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = r"[\x20\x09-\x0D]+"
BUCKET_ROWS, LEAST_BUCKETS, SHARD_GROUP = 50_000, 256, 1024
#: Slots whose coins one row throws.
COINS = 1 << 20


class Mix(NamedTuple):
    """rows: key, source, size, position; sources: targets; fragments of rows by block; slots by block."""

    rows: DataFrame
    sources: DataFrame
    fragments: DataFrame
    slots: DataFrame


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with weight, rank and target: the fixed point of capping and resharing.

    A target is min(most * size, level * weight) for one level. Sources in ascending order of
    most * size / weight are capped for as long as the level that the rest would get exceeds it.
    The windows run over one row for each source.
    """
    whole = Window.partitionBy()
    ranked = (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(min(share, most))))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("ratio", "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    capped = ranked.withColumn("fits", F.col("ratio") <= level)
    capped = capped.withColumn("capped", F.min("fits").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    taken = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - taken) / rest)
    return capped.withColumn("target", target).select("source", "source_size", "rank", "weight", "target")


def permuted(x: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, chosen by the salt, at x."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.expr("0") + F.ceil(n / a).cast("long")

    def network(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), v % b
        for step in (1, 2):
            left = (left + F.pmod(F.xxhash64(F.lit(2 * step), right, *salt), a)) % a
            right = (right + F.pmod(F.xxhash64(F.lit(2 * step + 1), left, *salt), b)) % b
        return left * b + right

    first = network(x)
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), a), first, lambda v, _: F.when(v < n, v).otherwise(network(v)))
    return F.when(first < n, first).otherwise(walk)


def upto(rows: DataFrame, by: str, order: str, value: str, group: int) -> DataFrame:
    """``rows`` with ``first``, the sum of the value over rows of lower order: sums of groups of orders, then within each."""
    rows = rows.withColumn("_group", F.floor(F.col(order) / group))
    sums = rows.groupBy(by, "_group").agg(F.sum(value).alias("_sum"))
    base = F.sum("_sum").over(Window.partitionBy(by).orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
    within = F.sum(value).over(Window.partitionBy(by, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    rows = rows.withColumn("_within", within).join(sums.select(by, "_group", base.alias("_base")), [by, "_group"])
    return rows.withColumn("first", F.col("_base") + F.col("_within")).drop("_group", "_within", "_base")


def _heads(seed: int, level: int, first: str, count: str) -> Column:
    """Heads of ``count`` fair coins, from number ``first`` on, a multiple of 64; each word of 64 coins is a hash, the last one's spare bits are cut off."""
    word = f"bit_count(shiftrightunsigned(xxhash64({seed}L, {level}, rank, shard, {first} div 64 + w), cast(64 - least(64L, {count} - 64 * w) as int)))"
    return F.when(F.expr(count) > 0, F.expr(f"aggregate(sequence(0L, ({count} - 1) div 64), 0L, (s, w) -> s + {word})")).otherwise(F.lit(0).cast("long"))


def drawn_counts(totals: DataFrame, levels: int, seed: int, most: int) -> DataFrame:
    """(rank, shard, count) of totals (rank, count): each rank's slots thrown evenly into 2**levels shards; ``most`` is the largest total.

    Above COINS slots a node's coins are thrown by several rows, and a level is a table of its own; the
    levels below are one plan without a shuffle.
    """
    spark = totals.sparkSession
    now = totals.select("rank", F.lit(0).cast("long").alias("shard"), F.col("count").cast("long").alias("count"))
    for level in range(levels):
        if most >> level > COINS // 2:  # a node may have some more than its even share
            runs = now.select("rank", "shard", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / COINS))).alias("run"))
            runs = runs.repartition(partitions(spark), "rank", "shard", "run").withColumn("own", F.least(F.lit(COINS).cast("long"), F.col("count") - F.col("run") * COINS)).withColumn("from", F.col("run") * COINS)
            left = runs.withColumn("heads", _heads(seed, level, "from", "own")).groupBy("rank", "shard", "count").agg(F.sum("heads").alias("heads"))
        else:
            left = now.withColumn("heads", _heads(seed, level, "0L", "count"))
        both = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("heads").alias("count")), F.struct((F.col("shard") * 2 + 1).alias("shard"), (F.col("count") - F.col("heads")).alias("count")))
        now = left.select("rank", F.explode(both).alias("n")).select("rank", "n.shard", "n.count").filter("count > 0")
        if most >> level > COINS // 2:
            now = staged(now, "level")
    return now


def plan(docs: DataFrame, key_col: str, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, block_words: int, shard_slots: int, seed: int) -> Mix:
    """Lay out blocks and slots; ``docs`` has ``key_col`` of ``with_key``."""
    width = partitions(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = staged(docs.select(F.col(key_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS))).cast("int"))

    runs = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    by_source = Window.partitionBy("source")
    runs = runs.withColumn("base", F.sum("words").over(by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    runs = staged(runs, "runs")
    sources = staged(targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    runs = runs.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.source", "bucket", "base", "rank", "source_size", "target")
    runs = staged(runs, "based")  # its size is known, so it goes to the rows, not all rows to it

    within = Window.partitionBy("source", "bucket").orderBy("id", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(within)).alias("d")
    placed = placed.join(runs.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.bucket") == F.col("r.bucket")))
    placed = placed.select("key", "id", "d.source", "rank", "size", "source_size", "target", (F.col("base") + F.col("upto") - F.col("size")).alias("position"))

    length = F.lit(block_words).cast("long")
    blocks = F.sequence(F.floor(F.col("position") / length), F.floor((F.col("position") + F.col("size") - 1) / length))
    fragments = placed.filter("size > 0").select("key", "id", "rank", "size", "position", F.explode(blocks).alias("block"))
    start, end = F.greatest("position", F.col("block") * length), F.least(F.col("position") + F.col("size"), (F.col("block") + 1) * length)
    fragments = fragments.select("key", "id", "rank", "block", "size", (start - F.col("block") * length).alias("from"), (end - F.col("block") * length).alias("to"), (start - F.col("position")).alias("word"))

    goal = F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * F.lit(float(most))))
    filled = sources.filter("source_size > 0").withColumn("goal", goal)
    filled = filled.withColumn("full", F.floor(F.col("source_size") / length)).withColumn("n", F.ceil(F.col("source_size") / length))
    filled = filled.withColumn("part", F.col("goal") % F.col("source_size"))
    filled = filled.withColumn("n_slots", F.floor(F.col("goal") / F.col("source_size")) * F.col("n") + F.ceil(F.col("part") / length)).filter("n_slots > 0")
    filled = staged(filled, "filled")  # a row for each source

    every = filled.agg(F.sum("n_slots").alias("n"), F.max("n_slots").alias("most")).first()
    levels = max(0, (-(-(every.n or 0) // shard_slots) - 1).bit_length())
    drawn = drawn_counts(filled.select("rank", F.col("n_slots").alias("count")), levels, seed, int(every.most or 0))
    drawn = upto(staged(drawn, "drawn"), "rank", "shard", "count", SHARD_GROUP)
    slots = drawn.join(filled.select("rank", "source_size", "full", "n", "n_slots", "part"), "rank").repartition(width, "rank", "shard")
    slots = slots.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    slots = slots.withColumn("pass", F.floor(F.col("slot") / F.col("n"))).withColumn("at", F.col("slot") % F.col("n"))
    slots = slots.withColumn("block", F.when(F.col("at") < F.col("full"), permuted(F.col("at"), F.col("full"), F.lit(seed), F.col("rank"), F.col("pass"))).otherwise(F.col("full")))
    whole = F.when(F.col("block") < F.col("full"), length).otherwise(F.col("source_size") - F.col("full") * length)
    cut = F.when((F.col("slot") == F.col("n_slots") - 1) & (F.col("part") % length > 0), F.col("part") % length)
    slots = slots.select("rank", "shard", "slot", "pass", "block", F.coalesce(F.least(cut, whole), whole).alias("take"))
    # Spark takes a side for as small as it was before its rows were made by ``explode``, and would send all slots through the driver
    slots, fragments = slots.hint("merge"), fragments.hint("merge")
    return Mix(placed, sources, fragments, slots)


_DEFAULTS = {"weights": (3.0, 1.0, 2.0), "share": 1.5, "most": 2.0, "block_words": 64, "shard_slots": 4096, "seed": 7}


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, options: dict) -> tuple[DataFrame, str, Mix]:
    key = fresh(docs, "_key")
    keyed = with_key(docs, id_col, key)
    return keyed, key, plan(keyed, key, id_col, text_col, source_col, **{**_DEFAULTS, **options})


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture: (shard, position, id_col, pass, word, words), runs of words in output order.

    ``position`` orders the blocks of a shard pseudorandomly; a block's runs share it.
    """
    seed = {**_DEFAULTS, **options}["seed"]
    *_, mix = _planned(docs, id_col, text_col, source_col, options)
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "slot"), "rank", "slot")
    slots = mix.slots.withColumn("position", F.row_number().over(order))
    words = F.least("to", "take") - F.col("from")
    return slots.join(mix.fragments, ["rank", "block"]).withColumn("words", words).filter("words > 0").select("shard", "position", F.col("id").alias(id_col), "pass", "word", "words")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per document (id_col, size, source_size, target, taken): the words that the mixture takes of it."""
    *_, mix = _planned(docs, id_col, text_col, source_col, options)
    uses = mix.slots.groupBy("rank", "block").agg(F.collect_list("take").alias("takes"))  # at most one a pass
    got = F.aggregate("takes", F.lit(0).cast("long"), lambda s, t: s + F.greatest(F.least(F.col("to"), t) - F.col("from"), F.lit(0)))
    words = mix.fragments.join(uses, ["rank", "block"]).select("key", got.alias("got")).groupBy("key").agg(F.sum("got").alias("taken"))
    return mix.rows.join(words, "key", "left").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with the words that the mixture takes as their text; documents it takes nothing of go.

    Each pass over a document adds its words once more, after a line break; a pass that takes
    the whole document adds its text as it is.
    """
    keyed, key, mix = _planned(docs, id_col, text_col, source_col, options)
    words = F.least("to", "take") - F.col("from")
    pieces = mix.slots.join(mix.fragments, ["rank", "block"]).withColumn("n", words).filter("n > 0")
    passes = pieces.groupBy("key", "pass").agg(F.first("size").alias("size"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("word", "n"))).alias("runs"))
    own, split = fresh(docs, "_passes"), fresh(docs, "_words")
    passes = passes.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("pass", (F.col("n") == F.col("size")).alias("whole"), "runs"))).alias(own))
    text = F.col(f"`{text_col}`").cast("string")
    part = lambda p: F.when(p["whole"], text).otherwise(F.array_join(F.flatten(F.transform(p["runs"], lambda r: F.slice(F.col(split), (r["word"] + 1).cast("int"), r["n"].cast("int")))), " "))
    joined = keyed.join(passes, key)
    partly = F.exists(own, lambda p: ~p["whole"])
    joined = joined.withColumn(split, F.when(partly, F.filter(F.split(text, SEPARATOR), lambda w: w != "")))
    # several uses of the words: Spark does not split the text anew for each run
    mixed = F.when(F.col(split).isNull(), F.array_repeat(text, F.size(own))).otherwise(F.transform(own, part))
    return joined.withColumn(text_col, F.array_join(mixed, "\n")).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the words that the mixture takes as their text, by ``mix_documents``.

    Rows with null or wordless text have nothing to take and go; a null source is a source of its
    own; rows that share an id, or have none, are mixed one by one; ``n_chars`` is brought up to
    date; other columns stay as they are, whatever their names; an empty table stays empty.
    """
    return with_length(mix_documents(docs))
