import collections
import re

import pytest
from pyspark.sql import functions as F

from stratalog.llm import mixing
from stratalog.llm.mixing import drawn_counts, mix_documents, op3_mixing, permuted, placements, taken, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshare(sizes, weights, share=1.5, most=2.0):
    """Cap and reshare, round by round."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total >= most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [5, 900, 0, 40, 40, 1, 1000], [7], [0, 0, 3]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    want = reshare(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1013])
def test_permutation(spark, n):
    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"), permuted(F.col("id"), F.lit(n).cast("long"), F.lit(4)).alias("q"))
    rows = df.collect()
    assert sorted(r.p for r in rows) == sorted(r.q for r in rows) == list(range(n))
    assert n < 100 or [r.p for r in rows] != [r.q for r in rows]


def test_draws_are_multinomial(spark, monkeypatch):
    """Counts add up, do not hang on how coins are dealt to rows, and spread as independent throws do."""
    totals = spark.createDataFrame([(1, 40_000), (2, 1), (3, 0), (4, 63), (5, 64 * 9 + 5)], "rank int, count long").filter("count > 0")
    seen = []
    for coins in (1 << 20, 128):
        monkeypatch.setattr(mixing, "COINS", coins)
        seen.append(sorted((r.rank, r.shard, r["count"]) for r in drawn_counts(totals, 6, 7, 40_000).collect()))
    assert seen[0] == seen[1] and all(0 <= s < 64 and n > 0 for _, s, n in seen[0])
    sums = collections.Counter()
    for rank, _, n in seen[0]:
        sums[rank] += n
    assert sums == {1: 40_000, 2: 1, 4: 63, 5: 64 * 9 + 5}
    own = [n for rank, _, n in seen[0] if rank == 1]
    chi = sum((n - 625) ** 2 / 625 for n in own)
    assert len(own) == 64 and 30 < chi < 110  # 63 degrees of freedom
    assert [tuple(r) for r in drawn_counts(totals.filter("rank = 4"), 0, 7, 63).select("rank", "shard", "count").collect()] == [(4, 0, 63)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_mixing(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op3_mixing(spark, sf).repartition(7).collect()))
    sizes, took, goal = collections.Counter(), collections.Counter(), {}
    for r in rows:
        source, size = docs[r.doc_id]
        assert r.size == size and 0 <= r.taken <= 2 * size
        sizes[source] += size
        took[source] += r.taken
        goal[source] = r.target
    assert len(rows) == len(docs)
    assert all(abs(took[s] - goal[s]) <= 1 for s in goal)
    order = sorted(goal)
    assert [goal[s] for s in order] == pytest.approx(reshare([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]))
    assert all(r.source_size == sizes[docs[r.doc_id][0]] for r in rows)


ODD = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (5, None, "y"), (6, "", "y"), (7, "w " * 300, "x"), (8, "q r", "z")]


def test_edges(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("rank", F.lit(0))
    rows = taken(df, block_words=4, shard_slots=5).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    by, goal = collections.Counter(), {}
    for r in rows:
        source = {1: "x", 7: "x", 8: "z", None: None}.get(r.doc_id, "y")
        by[source] += r.taken
        goal[source] = r.target
    assert all(abs(by[s] - t) <= 1 for s, t in goal.items())
    mixed = mix_documents(df.withColumn("key", F.lit(1)).withColumn("_key", F.lit(2)), block_words=4, shard_slots=5)
    got = mixed.collect()
    assert len(got) == sum(r.taken > 0 for r in rows) and sum(len(WORD.findall(r.text)) for r in got) == sum(r.taken for r in rows) and all((r.key, r._key) == (1, 2) for r in got)
    assert taken(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0


def test_documents_and_placements_agree(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(5 * i)), f"s{i % 4}") for i in range(30)], "doc_id long, text string, source string")
    per_doc = {r.doc_id: r.taken for r in taken(df, block_words=4, shard_slots=8).collect()}
    text = {r.doc_id: r.text for r in mix_documents(df, block_words=4, shard_slots=8).collect()}
    assert {d: len(WORD.findall(t)) for d, t in text.items()} == {d: n for d, n in per_doc.items() if n}
    runs = placements(df, block_words=4, shard_slots=8).collect()
    by, words = collections.Counter(), {d: collections.Counter() for d in per_doc}
    for r in runs:
        by[r.doc_id] += r.words
        words[r.doc_id].update(f"w{r.doc_id}_{j}" for j in range(r.word, r.word + r.words))
    assert by == {d: n for d, n in per_doc.items() if n}
    assert all(collections.Counter(WORD.findall(t)) == words[d] for d, t in text.items())


@pytest.mark.parametrize("mixed", [placements, taken, mix_documents])
def test_no_side_of_many_rows_is_broadcast(spark, mixed):
    """Slots and fragments are made by ``explode``, which Spark's estimates leave out: neither may be broadcast, nor all rows to their runs."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 200).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    df = mixed(docs)
    assert df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[rank#\d+, block#\d+L\]", ran) and not re.search(r"BroadcastHashJoin \[rank#\d+, block#\d+L\]", ran)
    assert not re.search(r"BroadcastHashJoin \[coalesce\(source.*BuildLeft", ran)
