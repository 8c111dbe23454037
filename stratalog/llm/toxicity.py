"""Operator 9: toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps the words of a clause to classes: insult, threat, target, negation,
report, other. Four machines read classes: negation and reported speech remember whether their
words came before (negation for ``REACH`` words, a report to the clause's end), the target machine
whether the clause addresses someone before the word or, read from right to left, after it; the
scoring machine turns insults and threats into weight. Their composition is one machine whose
output for a clause is weight by context. A clause matches where a threat with a target, an aimed
insult or several insults stand in it, neither negated nor reported. What the contexts weigh is
learned, within bounds that no label moves (``_held``): a threat with a target or an aimed insult
makes a text toxic; one insult without a target, and any number of negated or reported insults and
threats, do not.

Insults and threats are a short general list and what labelled rows teach: words, and beginnings
of words, that occur in toxic training texts far more often than chance explains. Those whose
occurrences mostly have a target right behind them are threats, the others insults. A logistic
model turns a text's clause weights into its score. All is fitted on at most ``MOST_TOXIC`` and
``MOST_CLEAN`` labelled ids, chosen by hash at every size of the input, near copies counted once
(the least id's text); what is learned is bounded by the words of those texts.

Edge cases: a null or empty text has no clause and gets the score of clean text; without labelled
rows the general list and the prior weights decide; labels that repeat an id teach the largest
value, texts that repeat an id the least text; rows that repeat or have null ids are scored one by
one; an empty table gives an empty result; long texts are read whole; other columns are ignored,
or carried by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import shingle_sets
from .staging import least_hashed, small_batches, staged
from .words import slices

MOST_TOXIC, MOST_CLEAN = 4000, 8000
#: Evidence, in nats, that a word or beginning is bound to toxic texts must exceed the logarithm of
#: the number tried by so much; and its least log-odds.
EVIDENCE, LEAST_ODDS = 2.0, 1.5
STEMS = (4, 5, 6)
CHUNK_BYTES = 2 << 20

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Fixed word lists in four languages.
GENERAL = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns dumb fool vermin filth trottel dummkopf abschaum versager connard imbécile abruti ordure estúpido imbécil basura inútil escoria",
    THREAT: "kill hurt beat destroy burn shoot stab strangle töten umbringen schlagen vernichten tuer frapper brûler détruire matar golpear quemar destruir",
    TARGET: "you your yours yourself he she they them him her du dein euch ihr sie tu toi vous votre ils elles tú usted ustedes ellos ellas",
    NEGATION: "not never no isn aren wasn don doesn nicht kein keine nie ne pas jamais nunca jamás",
    REPORT: "said says told claimed wrote quoted reported sagte behauptete schrieb meldete dit affirme écrit raconte dijo afirma escribió cuenta",
}
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n|]+")
#: Words that a negation reaches.
REACH = 3


class Machine:
    """A transducer: start state, and for (state, class) the next state and an output."""

    def __init__(self, start, step):
        self.start, self.step = start, lru_cache(maxsize=None)(step)

    def __or__(self, other: Machine) -> Machine:
        """Both read the same classes; states and outputs are pairs."""

        def step(state, symbol):
            (a, x), (b, y) = self.step(state[0], symbol), other.step(state[1], symbol)
            return (a, b), (x, y)

        return Machine((self.start, other.start), step)

    def then(self, other: Machine) -> Machine:
        """The other reads this one's output together with the class."""

        def step(state, symbol):
            a, x = self.step(state[0], symbol)
            b, y = other.step(state[1], (symbol, x))
            return (a, b), y

        return Machine((self.start, other.start), step)

    def backwards(self, symbols: list) -> list:
        """Its outputs, in the order of the symbols, where it reads them from the last to the first."""
        state, out = self.start, []
        for symbol in reversed(symbols):
            state, x = self.step(state, symbol)
            out.append(x)
        return out[::-1]

    def beside(self) -> Machine:
        """The same machine over pairs, of which it reads the first."""
        return Machine(self.start, lambda state, pair: self.step(state, pair[0]))


def _negation(left: int, symbol: int):
    return (REACH, False) if symbol == NEGATION else (max(0, left - 1), left > 0)


def _report(on: bool, symbol: int):
    return on or symbol == REPORT, on


def _target(seen: bool, symbol: int):
    return seen or symbol == TARGET, seen


#: Contexts of an insult or threat; the order of the features.
PLAIN, AIMED, NEGATED, REPORTED, THREATS = range(5)


def _score(state: None, read):
    (symbol, follows), ((negated, reported), before) = read
    aimed = before or follows
    if symbol != INSULT and not (symbol == THREAT and aimed):
        return None, None
    own = THREATS if symbol == THREAT else AIMED if aimed else PLAIN
    return None, NEGATED if negated else REPORTED if reported else own


TARGETS = Machine(False, _target)
#: Reads pairs of a word's class and whether a target follows, which TARGETS tells backwards.
GRAMMAR = (Machine(0, _negation) | Machine(False, _report) | TARGETS).beside().then(Machine(None, _score))


class Lexicon(NamedTuple):
    """Class and weight of words, and of beginnings."""

    words: dict[str, tuple[int, float]]
    stems: dict[str, tuple[int, float]]

    def find(self, word: str) -> tuple[int, float] | None:
        """The word's own entry, or its heaviest beginning's."""
        known = self.words.get(word)
        if known or not self.stems:
            return known
        held = [self.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.stems]
        return max(held, key=lambda e: e[1], default=None)


def general_lexicon() -> Lexicon:
    return Lexicon({w: (k, 4.0) for k, ws in GENERAL.items() for w in ws.split()}, {})


def clause_weights(text: str | None, lexicon: Lexicon) -> list[float]:
    """Of a text: the weight in each context, the heaviest unaimed insult, and the matched clauses."""
    out, alone, matched = [0.0] * 5, 0.0, 0
    text = (text or "").lower()
    known = {w: e for w in set(_WORD.findall(text)) if (e := lexicon.find(w))}
    marks = {w for w, (kind, _) in known.items() if kind in (INSULT, THREAT)}
    if not marks:
        return [*out, 0.0, 0.0]
    for clause in _CLAUSE.split(text):
        words = _WORD.findall(clause)
        if marks.isdisjoint(words):
            continue
        state, n = GRAMMAR.start, [0] * 5
        symbols = [known[w][0] if w in known else OTHER for w in words]
        for w, read in zip(words, zip(symbols, TARGETS.backwards(symbols), strict=True), strict=True):
            state, context = GRAMMAR.step(state, read)
            if context is not None:
                out[context] += known[w][1]
                n[context] += 1
                if context == PLAIN:
                    alone = max(alone, known[w][1])
        matched += n[AIMED] + n[THREATS] > 0 or n[PLAIN] > 1
    return [*out, alone, float(matched)]


#: Features by place: what is aimed, threats, unaimed insults beyond the heaviest, that one, what is negated, what is reported, matched clauses.
BIAS, F_AIMED, F_THREATS, F_SEVERAL, F_ALONE, F_NEGATED, F_REPORTED, F_MATCHED = range(8)


def _features(weights: np.ndarray) -> np.ndarray:
    w = weights.reshape(-1, 7)
    alone = w[:, 5]
    held = np.c_[w[:, AIMED], w[:, THREATS], w[:, PLAIN] - alone, alone, w[:, NEGATED], w[:, REPORTED], w[:, 6]]
    return np.c_[np.ones(len(w)), np.log1p(np.maximum(held, 0))]


#: Heaviest and lightest entry of a lexicon that was learned: bounds hold for both.
HEAVIEST, LIGHTEST = 6.0, LEAST_ODDS
#: Log-odds beyond which a text is toxic or clean at the threshold of 0.3, which is -0.85.
_TOXIC, _CLEAN = -0.7, -1.0


def _held(beta: np.ndarray) -> np.ndarray:
    """The coefficients within what the grammar says: a lone insult stays clean, one aimed insult or threat is toxic, what is negated or reported adds nothing."""
    b = beta.copy()
    b[BIAS] = min(b[BIAS], _CLEAN)
    b[[F_SEVERAL, F_MATCHED]] = np.maximum(b[[F_SEVERAL, F_MATCHED]], 0)
    b[F_ALONE] = min(b[F_ALONE], (_CLEAN - b[BIAS]) / np.log1p(HEAVIEST))
    b[[F_NEGATED, F_REPORTED]] = np.minimum(b[[F_NEGATED, F_REPORTED]], 0)
    least = (_TOXIC - b[BIAS] - b[F_MATCHED] * np.log1p(1.0)) / np.log1p(LIGHTEST)
    b[[F_AIMED, F_THREATS]] = np.maximum(b[[F_AIMED, F_THREATS]], max(least, 0.0))
    return b


#: Coefficients before any label is seen.
PRIOR = _held(np.array([-4.0, 1.8, 1.8, 1.0, 0.5, 0.0, 0.0, 1.2]))


def fit(weights: np.ndarray, toxic: np.ndarray, share: np.ndarray, pull: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic coefficients by Newton's method, near PRIOR and within ``_held``; ``share`` weighs the rows."""
    x, beta = _features(weights), PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (share * (p - toxic)) + pull * (beta - PRIOR)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(beta))
        beta = _held(beta - np.clip(np.linalg.solve(curve, gradient), -2, 2))
    return beta


class Model(NamedTuple):
    lexicon: Lexicon
    beta: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic, share) of at most MOST_TOXIC + MOST_CLEAN labelled rows; share restores the true proportion."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    parts = []
    for value, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        own = known.filter(F.col("toxic") == value)
        n = own.count()
        parts.append(least_hashed(own, n, most, "id").withColumn("share", F.lit(max(1.0, n / most))))
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most MOST_TOXIC + MOST_CLEAN rows of 20 bytes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(chosen, "id")
    return texts.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("share").alias("share"))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two MinHashes of each text, by which near copies are told."""
    for batch in slices(batches, "text", CHUNK_BYTES):
        h, cut = shingle_sets(batch.column("text"), 5)
        pairs = [(int(h[a:b].min() >> np.uint64(1)), int((h[a:b] * np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1))) if b > a else (0, 0) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.record_batch([*batch.columns, *(pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))], names=[*batch.schema.names, "one", "two"])


def _first(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows that agree on a sketch and the label, the least id's."""
    own = [c for c in rows.columns if c not in (key, "toxic")]
    return rows.groupBy(key, "toxic").agg(F.min_by(F.struct(*own), "id").alias("r")).select(key, "toxic", "r.*")


def _follow(features: frozenset[str]):
    """(feature, n, aimed): occurrences in the texts, and those with a target among the next two words."""
    targets = frozenset(GENERAL[TARGET].split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text in batch.column("text").to_pylist():
                for clause in _CLAUSE.split(text.lower()):
                    words = _WORD.findall(clause)
                    for i, w in enumerate(words):
                        for f in features.intersection((w, *(f"^{w[:n]}" for n in STEMS if len(w) > n))):
                            own = seen.setdefault(f, [0, 0])
                            own[0] += 1
                            own[1] += not targets.isdisjoint(words[i + 1 : i + 3])
            yield pa.record_batch([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], names=["feature", "n", "aimed"])

    return run


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and beginnings bound to toxic texts, by counts of texts that Spark takes."""
    rows = rows.mapInArrow(_sketch, "id long, text string, toxic int, share double, one long, two long")
    rows = staged(_first(_first(rows, "one"), "two").select("id", "text", "toxic"), "taught")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = F.flatten(F.transform("w", lambda w: F.transform(F.filter(F.array(*[F.lit(n) for n in STEMS]), lambda n: F.length(w) > n), lambda n: F.concat(F.lit("^"), F.substring(w, F.lit(1), n)))))
    seen = rows.select("toxic", words.alias("w")).select("toxic", F.explode(F.array_distinct(F.concat("w", stems))).alias("feature"))
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    lexicon = general_lexicon()
    if not total.get(1) or not total.get(0):
        return lexicon
    p = total[1] / (total[0] + total[1])
    bad, fine = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    counts = seen.groupBy("feature").agg(bad.alias("bad"), fine.alias("fine")).filter("bad >= 3")
    counts = staged(counts, "features")
    least = EVIDENCE + float(np.log(max(counts.count(), 1)))
    q = F.col("bad") / (F.col("bad") + F.col("fine"))
    evidence = F.col("bad") * F.log(q / p) + F.when(F.col("fine") > 0, F.col("fine") * F.log((1 - q) / (1 - p))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (total[1] + 1)) - F.log((F.col("fine") + 0.5) / (total[0] + 1))
    found = counts.withColumn("evidence", evidence).withColumn("odds", odds).filter((q > p) & (F.col("evidence") >= least) & (F.col("odds") >= LEAST_ODDS))
    odds_of = {r["feature"]: min(float(r["odds"]), 6.0) for r in found.select("feature", "odds").collect()}  # of the bounded sample's words
    if not odds_of:
        return lexicon
    follow = rows.filter("toxic = 1").select("text").mapInArrow(_follow(frozenset(odds_of)), "feature string, n long, aimed long")
    follow = follow.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("aimed").alias("aimed")).filter("aimed >= 3 and 2 * aimed >= n")
    threats = {r["feature"] for r in follow.select("feature").collect()}
    for feature, odd in odds_of.items():
        own = (THREAT if feature in threats else INSULT, odd)
        if feature.startswith("^"):
            lexicon.stems[feature[1:]] = own
        elif feature not in lexicon.words:
            lexicon.words[feature] = own
        elif lexicon.words[feature][0] in (INSULT, THREAT):
            lexicon.words[feature] = (lexicon.words[feature][0], odd)
    return lexicon


_WEIGHED = "id long, w array<double>, toxic int, share double"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    small_batches(docs.sparkSession)
    rows = staged(sample(docs, labels, id_col, text_col, label_col), "sample")
    lexicon = learn_lexicon(rows)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            w = [clause_weights(t, shared.value) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(w, pa.list_(pa.float64())), batch.column("toxic"), batch.column("share")], names=["id", "w", "toxic", "share"])

    found = rows.mapInArrow(run, _WEIGHED).orderBy("id").collect()  # at most MOST_TOXIC + MOST_CLEAN rows
    if len({r.toxic for r in found}) < 2:
        return Model(lexicon, PRIOR)
    return Model(lexicon, fit(np.array([r.w for r in found]), np.array([r.toxic for r in found]), np.array([r.share for r in found])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (id_col, score, clauses): probability of toxicity and number of matched clauses."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, beta = shared.value
        for batch in slices(batches, "text", CHUNK_BYTES):
            w = np.array([clause_weights(t, lexicon) for t in batch.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(_features(w) @ beta, -30, 30)))
            yield pa.record_batch([batch.column("id"), pa.array(p, pa.float64()), pa.array(w[:, -1].astype(np.int64))], names=["id", "score", "clauses"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double, clauses long").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """``docs`` without rows whose score reaches ``least``; row by row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, beta = shared.value
        for batch in slices(batches, text_col, CHUNK_BYTES):
            w = np.array([clause_weights(t, lexicon) for t in batch.column(names.index(text_col)).to_pylist()]).reshape(batch.num_rows, -1)
            p = 1 / (1 + np.exp(-np.clip(_features(w) @ beta, -30, 30))) if batch.num_rows else np.zeros(0)
            yield batch.filter(pa.array(p < least))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, labels.filter(~held_out))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without toxic rows, by ``drop_toxic`` with a model of all rows of ``labels``.

    Rows with null or empty text are clean and stay; long texts are read whole; rows that share an
    id, or have none, are judged one by one; other columns stay as they are, whatever their names;
    an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train(docs, labels))
