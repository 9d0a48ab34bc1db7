import hashlib
import random
import re

from quillon.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def texts():
    rng = random.Random(8)
    parts = ["password", "PassWD", "secret", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "hunter2hunter2", "x", "é🙂", "\n", "/+_.=-", "K", "ſ", "zQ9fT3xLp0"]
    fixed = [None, "", "token=secret:abcdefghijklmnop", "password=secret=abcdefghijklmnop", "AKIA" * 9, "a" * 15, "a" * 16, "🙂api_key: 'abcdefghijkl'", "f" * 50_000]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)]


def test_base_spans(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(rows)] + [(0, None, "x", 3)], "doc_id long, text string, spans string, base int")
    got = secrets.digest(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = brute(rows[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        named = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("markov")] == named and len(every) == len(named) + r.n_markov


def test_models_tell_random_from_ordinary(spark):
    words = "the quick brown fox jumps over lazy dogs while every other animal watches from some distance and thinks about dinner"
    docs = spark.createDataFrame([(i, words) for i in range(40)], "doc_id long, text string")
    ratios = secrets.log_ratios(secrets.random_samples(spark), secrets.ordinary_samples(docs))
    random_, ordinary = "zQ9fT3xLp0Vw8KjR2mN5bYc7", "everyotheranimalwatchesfromsome"
    df = spark.createDataFrame([(1, f"see {random_} there {ordinary} end")], "doc_id long, text string")
    assert [(s.start, s.end) for s in secrets.scan(df, ratios).first().spans] == [(4, 4 + len(random_))]


def test_empty(spark):
    assert secrets.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_random_runs_are_scored(spark, tiny):
    rng = random.Random(9)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choice(chars) for _ in range(n)) for n in (12, 14, 16, 18, 19) for _ in range(40)]
    plain = ["understanding", "international", "one_of_the_others", "the.inside.of"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    ratios = secrets.log_ratios(secrets.random_samples(spark), secrets.ordinary_samples(docs))
    df = spark.createDataFrame([(i, f"the {t} is") for i, t in enumerate(tokens + plain)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secrets.scan(df, ratios).collect()}
    assert sum(got[i] == [(4, 4 + len(t))] for i, t in enumerate(tokens)) >= 0.98 * len(tokens)
    assert all(got[len(tokens) + i] == [] for i in range(len(plain)))


def test_whole_texts_are_learned_from(spark):
    letters = "abcdefghij"
    words = ["x" + letters[i // 100] + letters[i // 10 % 10] + letters[i % 10] for i in range(1000)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = [r.token for r in secrets.ordinary_samples(df).collect()]
    assert got[:1000] == words and got[1000:] == ["_.-/="[i // 6 % 5].join(words[i : i + 6]) for i in range(0, 1000, 6)]
