import collections
import re
import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import minhash, mixing, secrets, staging, toxicity
from stratalog.llm.staging import staged
from stratalog.llm.substring_dedup import op1_substring_dedup
from stratalog.llm.tokens import encoder, vocabulary_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_against_plain_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    calm = staged(corpus_pipeline.STAGES[0][1](spark, docs, sf), "t")
    assert calm.columns == docs.columns
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("score >= 0.3").collect()}
    left = {r.doc_id: r for r in calm.collect()}
    assert left.keys() == rows.keys() - bad and bad and all(left[d] == rows[d] for d in left)

    single = staged(corpus_pipeline.STAGES[1][1](spark, calm, sf), "n")
    groups = collections.defaultdict(set)
    for r in minhash.near_duplicates(calm, percent=minhash.STAGE_PERCENT).collect():
        groups[r.component_id].add(r.doc_id)
    one = {r.doc_id: r for r in single.collect()}
    assert one.keys() == groups.keys() and len(one) < len(left) and all(one[d] == left[d] for d in one)

    clean = staged(corpus_pipeline.STAGES[2][1](spark, single, sf), "s")
    found = {r.doc_id: r.found for r in secrets.scan(single).collect()}
    out = {r.doc_id: r for r in clean.collect()}
    assert out.keys() == one.keys() and any(found.values())
    for d, r in out.items():
        text, at = "", 0
        for a, _, b in found[d]:
            if a >= at:
                text += one[d].text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == text + one[d].text[at:] and r.n_chars == len(r.text)

    mixed = staged(corpus_pipeline.STAGES[3][1](spark, clean, sf), "m")
    taken = {r.doc_id: r.taken for r in mixing.taken(clean).collect()}
    got = {r.doc_id: r for r in mixed.collect()}
    assert got.keys() == {d for d, n in taken.items() if n}
    assert all(len(WORD.findall(r.text)) == taken[d] and r.n_chars == len(r.text) for d, r in got.items())
    assert all(r.text == out[d].text for d, r in got.items() if taken[d] == len(WORD.findall(out[d].text)) and "\n".join([out[d].text]) == r.text)

    pieces = collections.Counter()
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect()
    for r in packed:
        pieces[r.doc_id] += r.length
    own = encoder(vocabulary_file())
    want = dict(zip(got, own.encode([r.text for r in got.values()]), strict=True))
    assert pieces == {d: len(x) + 1 for d, x in want.items()}
    assert sum(r.length for r in corpus_pipeline.run(spark, sf).collect()) == sum(pieces.values())


CLASH = ("key", "passes", "_key", "_words", "_runs", "_passes", "_chars", "id", "text_", "root", "cls", "kind", "start", "rank", "size", "w", "at", "task", "_task", "_at", "_content", "n")


def test_stages_keep_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, empty texts, repeated rows and ids, and columns named as the stages' own."""
    blob = "aB3" * 40
    rows = [(1, f"one two three four five six password='{blob}'", "x"), (1, f"one two three four five six password='{blob}'", "x"), (None, "null id words here now and then", None), (None, "other null id words go on and on", "y"), (2, None, "x"), (3, "", None), (4, "you worthless idiot, you pathetic scum", "y"), (5, "w " * 3000, "x")]
    df = spark.createDataFrame([(d, t, "en" if d else None, s, None if t is None else len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    labels = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    base = f"{staging.shared_dir(spark)}/odd-{uuid.uuid4().hex}"
    labels.write.parquet(f"{base}/labels.parquet")
    docs, counts = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, base), name)
        held = docs.collect()
        counts.append(len(held))
        assert docs.columns == df.columns and all(r[c] == f"own {c}" for r in held for c in CLASH), name
        assert stage(spark, df.limit(0), base).count() == 0
    assert counts == [7, 6, 6, 4] and all("[SECRET]" in r.text and blob not in r.text for r in docs.collect() if r.doc_id == 1)
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, base).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and sum(r.start == 0 for r in pieces) == len(rows)


def test_results_do_not_hang_on_the_number_of_partitions(spark):
    sf = "/root/testdata/sf0.001"
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([sorted(map(tuple, f(spark, sf).collect())) for f in (mixing.op3_mixing, op1_substring_dedup)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and seen[0][0]


def test_repeated_and_null_ids_are_numbered_by_content(spark):
    """Keys ascend with ids, nulls last, and do not depend on how rows are dealt."""
    rows = [(3, "c"), (None, "z"), (1, "b"), (1, "a"), (None, None), (2, ""), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = [sorted(map(tuple, staging.with_key(df.repartition(n), "doc_id", "k").collect()), key=lambda r: r[2]) for n in (1, 3, 5)]
    assert seen[0] == seen[1] == seen[2] and [r[2] for r in seen[0]] == list(range(7)) and [r[0] for r in seen[0]] == [1, 1, 1, 2, 3, None, None]
