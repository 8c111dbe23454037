"""Operator 8: secret scans, with DataFrame operations only.

Base patterns mark assignments, access keys and long hexadecimal strings. Beyond them, runs of
16 and more characters of the base64 alphabet are scored by two character Markov chains, one of
random strings and one of ordinary identifiers, trained from labelled samples; a run whose mean
log-likelihood ratio a character exceeds the threshold is a secret too, unless it overlaps a
base span.

One scan finds all matches. Their places follow from the lengths of the gaps between them,
summed per text over rows (not arrays), so a text with very many matches stays linear. Only
matches are shuffled, never texts. The chains are tables of 65 * 65 numbers.

Training samples: random strings derived from hashes; identifiers composed of common words, and
numbers; and the letter-only words of at most ``SAMPLE_ROWS`` texts, chosen by the hash of
their ids. Those bounds hold at every size of the input.

Edge cases: a null or empty text has no spans; rows that repeat or have null ids are scanned one
by one; an empty table gives an empty result; very long texts are scanned whole; other columns
are ignored, or carried by ``redact``. Equal starts order by kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import fresh, least_hashed, staged, with_key, with_length

#: Kind, pattern, and least length of the last group; fixed values.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
RANDOM = ("random", r"[A-Za-z0-9+/_=-]{16,}")
KINDS = [k for k, *_ in BASE] + [RANDOM[0]]

#: Redacted runs of a text beyond which it is cut into characters.
MANY = 32
SAMPLE_ROWS = 200
SAMPLE_STRINGS = 1500
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
#: Words of ordinary identifiers.
IDENTIFIER_WORDS = (
    "get set user name file path index count value list array string number buffer reader writer parse format build create update delete "
    "request response server client handler config option default error message status code data table column row key map node edge graph "
    "model view controller service manager factory session token account payment order customer product price total start stop begin end "
    "first last next previous current parent child root width height length size color image button window event listener thread queue "
    "stack cache memory process network socket connection database query result record field schema version module package test"
).split()


def labelled_samples(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(text, random): generated strings of both kinds, and words of a bounded sample of ``texts`` (id, text)."""
    seed = spark.range(SAMPLE_STRINGS)
    digest = lambda n: F.sha2(F.concat_ws(":", F.lit(n), F.col("id").cast("string")), 256)
    compact = F.translate(F.base64(F.unhex(digest(1))), "=", "")
    random = seed.select(F.explode(F.array(compact, F.substring(digest(2), 1, 40), F.upper(F.substring(compact, 1, 24)), F.translate(F.base64(F.unhex(digest(3))), "=+/", ""))).alias("text"))
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    pick = lambda n: F.element_at(words, (F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    three = [pick(n) for n in range(3)]
    number = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(10**18)).cast("string")
    ordinary = seed.select(F.explode(F.array(F.concat(three[0], F.initcap(three[1]), F.initcap(three[2])), F.concat_ws("_", *three), F.upper(F.concat_ws("_", *three)), F.concat_ws("/", *three), number)).alias("text"))
    some = least_hashed(texts, texts.count(), SAMPLE_ROWS, "id", "text")
    found = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("text"))
    return random.withColumn("random", F.lit(1)).union(ordinary.union(found).withColumn("random", F.lit(0)))


def _symbol(ch: Column) -> Column:
    return F.instr(F.lit(ALPHABET), ch)  # 0: any other character


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of random against ordinary for each (previous, next) symbol, row by row."""
    at = samples.filter(F.length("text") > 1).select("text", "random", F.explode(F.sequence(F.lit(2), F.length("text"))).alias("i"))
    pair = at.select("random", F.expr("substring(text, i - 1, 1)").alias("p"), F.expr("substring(text, i, 1)").alias("c"))
    pair = pair.select("random", F.instr(F.lit(ALPHABET), F.col("p")).alias("p"), F.instr(F.lit(ALPHABET), F.col("c")).alias("c"))
    size = len(ALPHABET) + 1
    counts = [[[smoothing] * size for _ in range(size)] for _ in range(2)]
    for r in pair.groupBy("random", "p", "c").count().collect():  # at most 2 * 65 * 65 rows
        counts[r["random"]][r["p"]][r["c"]] += r["count"]
    ratio = []
    for p in range(size):
        total = [sum(counts[k][p]) for k in range(2)]
        ratio += [math.log(counts[1][p][c] / total[1]) - math.log(counts[0][p][c] / total[0]) for c in range(size)]
    return ratio


def mean_ratio(text: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's transitions; the string is cut into symbols once, so long ones cost in proportion."""
    size = len(ALPHABET) + 1
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    symbols = F.transform(F.split(text, ""), _symbol)

    def step(state: Column, c: Column) -> Column:
        ratio = F.when(state["last"] < 0, 0.0).otherwise(F.element_at(ratios, F.greatest(state["last"], F.lit(0)) * size + c + 1))
        return F.struct(c.alias("last"), (state["total"] + ratio).alias("total"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"))
    return F.aggregate(symbols, start, step, lambda s: s["total"]) / (F.length(text) - 1)


def find(keyed: DataFrame, key_col: str, text_col: str, table: list[float], least_ratio: float) -> DataFrame:
    """(key, kind, start, end): kind by its place in KINDS, code points, end exclusive."""
    text = F.col(f"`{text_col}`").cast("string")
    found = []
    for n, (_, pattern, group, _least) in enumerate(BASE):
        may = {0: text.rlike("(?i)password|passwd|secret|token|api_?key"), 1: text.contains("AKIA")}.get(n, text.rlike(pattern))
        found.append(F.when(may, _matches(text, n, pattern, group)))
    found.append(F.when(text.rlike(RANDOM[1]), _matches(text, len(BASE), RANDOM[1], 0)))
    hits = keyed.select(F.col(key_col).alias("key"), F.explode(F.array(*found)).alias("of")).filter("size(of.whole) > 0")
    hits = hits.select("key", "of.kind", F.posexplode(F.arrays_zip("of.whole", "of.part", "of.gap")).alias("n", "hit")).filter("hit.whole is not null")
    hits = hits.select("key", "kind", "n", F.length("hit.gap").alias("gap"), F.length("hit.whole").alias("length"), F.length("hit.part").alias("part"), F.when(F.col("kind") == len(BASE), F.col("hit.whole")).alias("whole"))
    upto = Window.partitionBy("key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).withColumn("start", F.col("end") - F.col("length"))
    least = F.element_at(F.array(*[F.lit(x) for *_, x in BASE], F.lit(0)), F.col("kind") + 1)
    likely = F.when(F.col("kind") < len(BASE), True).otherwise(mean_ratio(F.col("whole"), table) > least_ratio)
    hits = hits.filter(F.col("part") >= least).filter(likely).select("key", "kind", "start", "end")
    # a span overlaps a base span before it if one of those ends after its start, and one after it if the first of those starts before its end
    by = Window.partitionBy("key").orderBy("start", "kind")
    base = lambda c: F.when(F.col("kind") < len(BASE), F.col(c))
    before = F.max(base("end")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(base("start"), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    hits = hits.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return staged(hits.filter((F.col("kind") < len(BASE)) | free).select("key", "kind", "start", "end"), "hits")


def _matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Of one kind: whole matches, the group whose length counts, and the gap before each match."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    return F.struct(F.lit(kind).alias("kind"), whole.alias("whole"), part.alias("part"), F.split(text, pattern, -1).alias("gap"))


def chain(docs: DataFrame, id_col: str, text_col: str) -> list[float]:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return train(labelled_samples(docs.sparkSession, texts))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = 0.5) -> DataFrame:
    """Per row (id_col, found): its spans as an array of (start, kind, end), in order."""
    key = fresh(docs, "_key")
    keyed = with_key(docs, id_col, key)
    hits = find(keyed, key, text_col, chain(docs, id_col, text_col), least_ratio)
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    rows = keyed.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias(id_col))
    return rows.join(spans, "key", "left").select(id_col, F.coalesce("found", F.array().cast(spans.schema["found"].dataType)).alias("found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each maximal run of overlapping spans replaced by ``mark``; all rows stay."""
    key, own, chars = (fresh(docs, n) for n in ("_key", "_runs", "_chars"))
    keyed = with_key(docs, id_col, key)
    hits = find(keyed, key, text_col, chain(docs, id_col, text_col), least_ratio)
    order = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(order), F.lit(0))).cast("int"))
    hits = hits.withColumn("run", F.sum("new").over(Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    runs = hits.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(own))
    joined = keyed.join(runs, key, "left")
    text = F.col(f"`{text_col}`").cast("string")
    # substring walks from the text's start, so a text of many runs is cut into characters once
    joined = joined.withColumn(chars, F.when(F.size(own) > MANY, F.split(text, "")))
    froms = F.concat(F.array(F.lit(0).cast("long")), F.col(f"{own}.end"))
    tos = F.concat(F.col(f"{own}.start"), F.array(F.length(text).cast("long")))
    gaps = F.transform(F.arrays_zip(froms.alias("a"), tos.alias("b")), lambda x: F.struct((x["a"] + 1).cast("int").alias("at"), (x["b"] - x["a"]).cast("int").alias("n")))
    few = F.transform(gaps, lambda g: F.substring(text, g["at"], g["n"]))
    many = F.transform(gaps, lambda g: F.array_join(F.slice(F.col(chars), g["at"], g["n"]), ""))
    kept = F.when(F.col(chars).isNull(), few).otherwise(many)  # two uses of the characters: Spark does not cut them anew in the lambda
    return joined.withColumn(text_col, F.when(F.col(own).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, mark))).select(*docs.columns)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, and the spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with every secret replaced by a mark, by ``redact``; all rows stay.

    Null and empty texts stay as they are, very long ones are scanned whole; rows that share an id,
    or have none, are scanned one by one; ``n_chars`` is brought up to date; other columns stay as
    they are, whatever their names; an empty table stays empty.
    """
    return with_length(redact(docs))
