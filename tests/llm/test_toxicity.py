import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.llm import toxicity as tox


def weights(text):
    return tox.clause_weights(text, tox.general_lexicon())


def test_grammar():
    assert weights("Nothing here.") == [0.0] * 7 == weights(None) == weights("")
    assert weights("An idiot.")[tox.PLAIN] == 4
    assert weights("You idiot!")[tox.AIMED] == 4
    assert weights("you are not an idiot")[tox.NEGATED] == 4
    assert weights("not one two idiot")[tox.NEGATED] == 4 and weights("not one two three idiot")[tox.PLAIN] == 4
    assert weights("he said idiot")[tox.REPORTED] == 4 and weights("he said. idiot")[tox.PLAIN] == 4
    assert weights("you we kill")[tox.THREATS] == 4 and weights("we kill weeds")[tox.THREATS] == 0
    assert weights("idiot moron. scum")[-2:] == [4.0, 1.0]  # a clause of two insults matches, a lone one does not
    assert weights("idiot. moron")[-1] == 0 and weights("you idiot. kill you. not you idiot, moron")[-1] == 2
    assert weights("he said I will kill you")[tox.REPORTED] == 4 and weights("I will never kill you")[tox.NEGATED] == 4


def test_target_after_threat_or_insult():
    for text in ("I will kill you", "we will destroy them", "wir vernichten euch", "ich will schlagen, dich und sie", "on va tuer vous tous", "je vais brûler votre maison", "vamos a destruir a ustedes", "voy a matar a ellos"):
        assert weights(text)[tox.THREATS] == 4 and weights(text)[-1] == 1, text
    assert weights("we will not kill you")[tox.THREATS] == 0 == weights("we kill weeds. you see")[tox.THREATS]
    assert weights("idiots, all of you")[tox.AIMED] == 4 and weights("idiots. all of you")[tox.PLAIN] == 4
    assert weights("not idiots, you")[tox.NEGATED] == 4 and weights("he said idiots, you")[tox.REPORTED] == 4
    assert weights("kill you kill")[tox.THREATS] == 8


def test_stems():
    lexicon = tox.Lexicon({}, {"gruff": (tox.INSULT, 3.0), "gruf": (tox.INSULT, 2.0)})
    assert tox.clause_weights("gruffly gruff", lexicon)[tox.PLAIN] == 5.0


def test_matched_clauses_count_before_any_label():
    score = lambda t: float(1 / (1 + np.exp(-(tox._features(np.array([weights(t)])) @ tox.PRIOR)[0])))
    assert all(score(t) >= 0.3 for t in ("I will kill you", "you are stupid", "idiots, all of you", "worthless stupid trash"))
    assert all(score(t) < 0.3 for t in ("stupid", "he said stupid", "you are not stupid", "we kill weeds", "you said stupid"))


SENTENCES = {
    True: ("I will kill you", "you are stupid", "idiots, all of you", "worthless stupid trash", "he said no. I will kill you"),
    False: ("stupid", "An idiot came by.", "you are not an idiot", "He said I will kill you", "we will not kill you", "he told them you are an idiot, a moron", "we kill weeds", "never stupid, never scum", ""),
}


@pytest.fixture(scope="module")
def fitted(spark):
    """Models of the rows that op9 learns from."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    tables = lambda sf: [spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels")]
    return {sf: tox.train(docs, labels.filter(~held_out)) for sf in ("sf0.001", "sf0.01", "sf0.1") for docs, labels in [tables(sf)]}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_contexts_hold_after_fitting(fitted, sf):
    """What stands alone, is negated or reported stays clean, whatever the labels have taught; a matched clause does not."""
    lexicon, beta = fitted[sf]
    for toxic, texts in SENTENCES.items():
        for t in texts:
            p = 1 / (1 + np.exp(-(tox._features(np.array([tox.clause_weights(t, lexicon)])) @ beta)[0]))
            assert (p >= 0.3) == toxic, (t, p)
    for word, (kind, _) in lexicon.words.items():
        p = 1 / (1 + np.exp(-(tox._features(np.array([tox.clause_weights(word, lexicon)])) @ beta)[0]))
        assert p < 0.3 or kind == tox.THREAT, word


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32))
def test_bounds_hold_for_any_labels(seed):
    rng = np.random.default_rng(seed)
    w = rng.choice([0.0, 1.5, 4.0, 12.0], (60, 7))
    w[:, 5] = np.minimum(w[:, 5], np.minimum(w[:, tox.PLAIN], 6.0))
    beta = tox.fit(w, rng.integers(0, 2, 60), np.ones(60))
    score = lambda *x: (tox._features(np.array([x], dtype=float)) @ beta)[0]
    line = np.log(0.3 / 0.7)
    for weight in (1.5, 4.0, 6.0):
        assert score(weight, 0, 0, 0, 0, weight, 0) < line <= min(score(0, weight, 0, 0, 0, 0, 1), score(0, 0, 0, 0, weight, 0, 1))
        assert score(0, 0, 9 * weight, 7 * weight, 0, 0, 0) < line and score(weight, 0, 50, 50, 0, weight, 0) < line


def plain_score(text, model):
    """The scoring by rules, clause by clause and word by word."""
    lexicon, beta = model
    total = dict.fromkeys(("aimed", "threats", "plain", "negated", "reported"), 0.0)
    alone, matched = 0.0, 0
    for clause in re.split(r"[.!?;:\n|]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        entry = [lexicon.find(w) for w in words]
        kind = [e[0] if e else tox.OTHER for e in entry]
        hits = []
        for i, e in enumerate(entry):
            aimed = any(k == tox.TARGET for j, k in enumerate(kind) if j != i)
            if kind[i] not in (tox.INSULT, tox.THREAT) or (kind[i] == tox.THREAT and not aimed):
                continue
            if tox.NEGATION in kind[max(0, i - 3) : i]:
                hits.append("negated")
            elif tox.REPORT in kind[:i]:
                hits.append("reported")
            else:
                hits.append("threats" if kind[i] == tox.THREAT else "aimed" if aimed else "plain")
            total[hits[-1]] += e[1]
            if hits[-1] == "plain":
                alone = max(alone, e[1])
        matched += "aimed" in hits or "threats" in hits or hits.count("plain") > 1
    x = [total["aimed"], total["threats"], total["plain"] - alone, alone, total["negated"], total["reported"], matched]
    return 1 / (1 + np.exp(-(beta[0] + sum(b * np.log1p(max(v, 0)) for b, v in zip(beta[1:], x, strict=True)))))


def test_query_against_plain_scoring(spark, fitted):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = tox.op9_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.isclose(r.score, plain_score(texts[r.doc_id], fitted["sf0.001"])) and r.predicted == (r.score >= 0.3)
    odd = [t for own in SENTENCES.values() for t in own] + ["You, not one two three four idiot; you said it: kill him", None]
    got = tox.score(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), fitted["sf0.1"]).collect()
    assert all(np.isclose(r.score, plain_score(odd[r.doc_id], fitted["sf0.1"])) for r in got)


def test_lexicon_against_a_plain_count(spark):
    """Invented words: one that insults, one that threatens (a target follows), one that is everywhere."""
    rows, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        u = [f"w{i * 12 + j}x".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(12)]  # texts share no five words
        text = " ".join([*u[:4], "common", *u[4:8], *(["zorgel", u[8], "wesen.", u[9], "blick you", u[10], "blick them"] if bad else ["plain"]), u[11]])
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(0, "zzz"), (None, "zorgel")]
    docs, taught = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = tox.sample(docs, taught, "doc_id", "text", "toxic")
    lexicon = tox.learn_lexicon(sample)
    texts = [(r.text, r.toxic) for r in sample.collect()]
    assert len(texts) == 120
    seen = {k: sum(t == k for _, t in texts) for k in (0, 1)}
    words = {w for t, _ in texts for w in re.findall(r"[^\W\d_]+", t)}
    counts = {w: [sum(y == k and w in t.split() or y == k and f"{w}." in t.split() for t, y in texts) for k in (0, 1)] for w in words}
    want = {w: np.log((bad + 0.5) / (seen[1] + 1)) - np.log((fine + 0.5) / (seen[0] + 1)) for w, (fine, bad) in counts.items() if bad == seen[1] and not fine}
    own = {w: e for w, e in lexicon.words.items() if w in words and w not in tox.general_lexicon().words}
    assert {"zorgel", "blick", "wesen"} == own.keys() <= want.keys()
    assert all(np.isclose(e[1], min(want[w], 6.0)) for w, e in own.items())
    assert own["blick"][0] == tox.THREAT and own["zorgel"][0] == tox.INSULT


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = tox.op9_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    hit = sum(t and p for t, p in held)
    print("recall", hit / sum(t for t, _ in held), "precision", hit / max(1, sum(p for _, p in held)), len(held))
    assert hit >= 0.9 * sum(t for t, _ in held) and hit >= 0.9 * sum(p for _, p in held)


def test_edges(spark):
    df = spark.createDataFrame([(1, "you idiot, you moron", "a"), (1, "you idiot, you moron", "a"), (None, None, "b"), (3, "", None), (4, "fine words " * 30000, "c")], "doc_id long, text string, score string").withColumn("toxic", F.lit(5))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(df.select("doc_id", "text"), none)
    assert np.array_equal(model.beta, tox.PRIOR)
    got = {(r.doc_id, r.score >= 0.3) for r in tox.score(df, model).collect()}
    assert got == {(1, True), (None, False), (3, False), (4, False)}
    kept = tox.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 3
    assert tox.score(df.limit(0), model).count() == 0 == tox.drop_toxic(df.limit(0), model).count()
