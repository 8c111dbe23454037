"""Operator 7: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all training rows in Spark: each task returns its sums by (language,
bucket), Spark adds them up. The matrix of log-probabilities, languages x ``BUCKETS``, is
broadcast. Scoring turns a batch of texts into sparse counts (text, bucket) and multiplies. A
matrix holds at most ``LANGUAGES`` languages; where there are more, each page of so many, in order
of their names, is trained and scored by itself, and the pages' best languages are ranked in the
end (``identify``), so results are those of one large matrix.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; so does every text if
there is nothing to learn from; ties go to the first language in order; rows with null language
or text teach nothing; repeated rows, and rows without id, teach and are scored one by one; very
long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import fresh, small_batches, staged, with_key
from .words import mix, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
LANGUAGES = 250
CHUNK_BYTES = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_SALT = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 4, dtype=np.uint64)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every n-gram of the lower-cased texts, and the index of its text.

    A text is read as " text "; digits and the like count as they are.
    """
    padded = [f" {t.lower()} " for t in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(padded)), size)
    found, docs = [], []
    gram = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        gram = gram[: len(points) - n + 1] << np.uint64(21) | points[n - 1 :]  # 21 bits a code point
        if n in ORDERS:
            inside = doc[: len(gram)] == doc[n - 1 :]
            found.append((mix(gram[inside] ^ _SALT[n]) & np.uint64(BUCKETS - 1)).astype(np.int32))
            docs.append(doc[: len(gram)][inside])
    return np.concatenate(found), np.concatenate(docs)


def _count(languages: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in slices(batches, "text", CHUNK_BYTES):
            lang = np.array([languages[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            bucket, doc = ngrams([t or "" for t in batch.column("text").to_pylist()])
            counts += np.bincount(lang[doc] * BUCKETS + bucket, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["cell", "n"])

    return run


Model = tuple[list[str], np.ndarray]


def train(docs: DataFrame, text_col: str, lang_col: str, smoothing: float = 0.5, after: str | None = None) -> Model:
    """A page of languages in order, those after ``after``, and the matrix of log-probabilities with each prior in its last column."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    all_rows = rows.count()
    rows = rows if after is None else rows.filter(F.col("lang") > after)
    priors = rows.groupBy("lang").count().orderBy("lang").limit(LANGUAGES).collect()
    names = [r["lang"] for r in priors]
    if not names:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    own = rows.filter(F.col("lang") <= names[-1])
    sums = own.mapInArrow(_count({x: i for i, x in enumerate(names)}), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.full(len(names) * BUCKETS, smoothing)
    table = sums.toArrow()  # at most LANGUAGES * BUCKETS rows
    counts[table.column("cell").to_numpy()] += table.column("n").to_numpy()
    counts = counts.reshape(len(names), BUCKETS)
    prior = np.array([r["count"] for r in priors], dtype=np.float64)
    return names, np.c_[np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(prior / all_rows)].astype(np.float32)


def lettered(text: str) -> bool:
    """Whether any character is a letter to Unicode; its other numerals are not."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def score_texts(texts: list[str], names: list[str], matrix: np.ndarray, temperature: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: best language, its log-probability, what divides such evidence (n-grams ** temperature), and the sum of all languages' odds against the best."""
    bucket, doc = ngrams(texts)
    cell, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    total = np.zeros((len(texts), len(names)))
    weights = matrix[:, :-1].T[cell % BUCKETS] * count[:, None]
    first = np.flatnonzero(np.r_[True, np.diff(cell // BUCKETS) > 0]) if len(cell) else np.zeros(0, np.int64)
    if len(cell):
        total[(cell // BUCKETS)[first]] = np.add.reduceat(weights, first, axis=0)
    total = total + matrix[:, -1]
    divide = np.maximum(np.bincount(doc, minlength=len(texts)), 1) ** temperature
    top = total.max(axis=1)
    return [names[b] for b in total.argmax(axis=1)], top, divide, np.exp((total - top[:, None]) / divide[:, None]).sum(axis=1)


def _scored(docs: DataFrame, model: Model, columns: dict[str, str], temperature: float) -> DataFrame:
    """The named columns (new: old) with lang, top, divide and mass of ``score_texts``; lang is null for texts without letter."""
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lang, *numbers = score_texts(texts, names, shared.value, temperature)
            lang = [x if lettered(t) else None for x, t in zip(lang, texts, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in columns if c != "text"), pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], names=[*(c for c in columns if c != "text"), "lang", "top", "divide", "mass"])

    rows = docs.select(*[F.col(f"`{old}`").cast("string" if new == "text" else "long").alias(new) for new, old in columns.items()])
    kept = ", ".join(f"{c} long" for c in columns if c != "text")
    return rows.mapInArrow(run, f"{kept}, lang string, top double, divide double, mass double")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", temperature: float = 0.5) -> DataFrame:
    """Per row (id_col, lang_pred, score), among the languages of one page."""
    small_batches(docs.sparkSession)
    if not model[0]:
        return docs.select(F.col(id_col).cast("long").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = _scored(docs, model, {"id": id_col, "text": text_col}, temperature)
    return rows.select(F.col("id").alias(id_col), F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(F.col("lang").isNull(), 0.0).otherwise(1 / F.col("mass")).alias("score"))


def identify(docs: DataFrame, taught: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", temperature: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (id_col, lang_pred, score), with all languages of ``taught``, page by page."""
    model = train(taught, text_col, lang_col)
    if len(model[0]) < LANGUAGES:
        return predict(docs, model, id_col, text_col, temperature)
    key = fresh(docs, "_key")
    keyed = with_key(docs, id_col, key)
    pages = None
    while model[0]:
        page = staged(_scored(keyed, model, {"key": key, "id": id_col, "text": text_col}, temperature), "page")
        pages = page if pages is None else pages.union(page)
        model = train(taught, text_col, lang_col, after=model[0][-1])
    best = pages.groupBy("key").agg(F.first("id").alias("id"), F.max("top").alias("best"), F.first("divide").alias("divide"), F.collect_list(F.struct("lang", "top", "mass")).alias("of"))  # a row for each page
    mass = F.aggregate("of", F.lit(0.0), lambda s, p: s + p["mass"] * F.exp((p["top"] - F.col("best")) / F.col("divide")))
    lang = F.array_min(F.transform(F.filter("of", lambda p: p["top"] == F.col("best")), lambda p: p["lang"]))
    return best.select(F.col("id").alias(id_col), F.coalesce(lang, F.lit("und")).alias("lang_pred"), F.when(lang.isNull(), 0.0).otherwise(1 / mass).alias("score"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = identify(docs, docs.filter(~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
