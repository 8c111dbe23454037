import hashlib
import random
import re
import string
import time

from pyspark.sql import functions as F

from stratalog.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text or "") if len(m[0]) >= 32]
    return sorted(found)


def as_text(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(rows, got):
    assert len(rows) == len(got)
    for r in got:
        text = rows[r.doc_id]
        want = base_spans(text)
        assert [sum(k == i for _, k, _ in want) for i in range(3)] == [r.n_assign, r.n_access, r.n_hex]
        assert r.base_sha256 == hashlib.sha256(as_text(want).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert as_text(want) == ",".join(":".join(x) for x in spans if x[0] != "random")
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)
        assert all(re.fullmatch("[A-Za-z0-9+/_=-]{16,}", text[int(a) : int(b)]) for k, a, b in spans if k == "random")


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = secrets.op8_secrets(spark, sf).collect()
    check(rows, got)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 10
    assert sum("random" in r.spans for r in got) < 10  # the words of this table are not secrets


def test_edges(spark):
    deep = "".join(random.Random(3).choices(string.ascii_letters + string.digits, k=40))
    texts = [None, "", "é😀 password=abcdefgh😀 token: 'x' secret=token=12345678", "PASSWD\"= \"AKIA" + "Q" * 12, "AKIA" + "A" * 11, "a" * 31 + "g" + "b" * 32, "secret: token: abcdefgh", f"key {deep} end", "ſecret=abcdefgh", ("api_key='" + "z" * 9 + "' ") * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("found", F.lit(2))
    got = secrets.digest(secrets.scan(df)).collect()
    check(dict(enumerate(texts)), got)
    assert {r.doc_id: r.spans for r in got}[7] == "random:4:44"
    redacted = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert len(redacted) == len(texts) and redacted[7] == "key [SECRET] end" and redacted[0] is None and redacted[4] == texts[4]
    assert redacted[9].count("[SECRET]") == 2000 and "zzz" not in redacted[9]
    twice = spark.createDataFrame([(1, deep), (1, deep), (None, "x")], "doc_id long, text string")
    assert sorted(len(r.found) for r in secrets.scan(twice).collect()) == [0, 1, 1]
    assert secrets.scan(df.limit(0)).count() == 0


def test_chains_on_unseen_strings(spark):
    rng = random.Random(11)
    rand = ["".join(rng.choices(string.ascii_letters + string.digits, k=28)) for _ in range(300)] + ["".join(rng.choices("0123456789abcdef", k=30)) for _ in range(300)]
    ordinary = ["readUserAccountFromDatabase", "MAX_CONNECTION_RETRY_COUNT", "einschreibungsverfahrenheit", "internationalisation_settings", "4187204975550139", "src/main/resources/templates", "approximationsverfahren", "http_response_status_code"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = secrets.chain(docs, "doc_id", "text")
    df = spark.createDataFrame([(s, 1) for s in rand] + [(s, 0) for s in ordinary], "s string, random int")
    rows = df.select("s", "random", (secrets.mean_ratio(F.col("s"), table) > 0.5).alias("hit")).collect()
    assert sum(r.hit for r in rows if r.random) >= 0.97 * len(rand)
    assert [r.s for r in rows if r.hit and not r.random] == []


def test_long_texts_cost_in_proportion(spark):
    """A megabyte of base64 in one run, and twenty thousand secrets in one text; both once took time by the square."""
    rng = random.Random(1)
    blob = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=1 << 20))
    many = " ".join(f"api_key='{''.join(rng.choices(string.ascii_letters, k=12))}' x" for _ in range(20000))
    df = spark.createDataFrame([(1, blob), (2, many)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert time.perf_counter() - began < 60  # seconds either way; hours by the square
    assert got[1] == "[SECRET]" and got[2].count("[SECRET]") == 20000


def test_overlaps_against_plain_rule(spark):
    """A random run counts only where it overlaps no base span, wherever that starts."""
    deep = "".join(random.Random(5).choices(string.ascii_letters + string.digits, k=30))
    texts = [f"token={deep}", f"{deep}/token=abcdefgh", f"{deep} token=abcdefgh {deep}", f"AKIA{'Q' * 14}/{deep}", f"{deep}={'0123456789abcdef' * 3}"]
    got = {r.doc_id: [(a, k, b) for a, k, b in r.found] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, text in enumerate(texts):
        base, runs = base_spans(text), [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text)]
        free = {(a, b) for a, b in runs if not any(s < b and a < e for s, _, e in base)}
        assert {(a, b) for a, k, b in got[d] if k == 3} <= free and [x for x in got[d] if x[1] < 3] == base
    assert sum(k == 3 for _, k, _ in got[2]) == 2
