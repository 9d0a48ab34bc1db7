"""Secret scans: fixed patterns, and character Markov models by log-likelihood ratio.

Everything is DataFrame expressions. A pattern's spans come from the gaps between its
matches (split) and the matches themselves (regexp_extract_all), both leftmost and not
overlapping; offsets are code points, ends exclusive.

The Markov models are bigram models over character classes: one of random strings, one of
ordinary identifiers, counted over labelled samples; few counts fall back on how common the
second character is. A token is
flagged where the mean log-likelihood ratio per transition is over a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 or more: a longer run would have to begin with an earlier AKIA
HEX = r"[0-9a-f]{16,}"
#: What the models look at: runs of the characters of secrets, as long as an assigned one at least.
CANDIDATE = r"[A-Za-z0-9+/_.=-]{12,}"
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
KINDS = ("assign", "access", "hex", "markov")
#: Ordinary identifiers are learned from at most so many documents.
TRAIN_DOCUMENTS = 2000
TRAIN_RANDOM = 2000
THRESHOLD = 0.9  # nats a transition


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, kind, end>> of the pattern's matches in text; keep: a test of a match's second group."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else found
    gaps = F.split(text, pattern, -1)
    # Each match with the gap before it; a fold adds up the lengths.
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), second.alias("part"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        low = acc["at"] + F.length(x["gap"])
        high = low + F.length(x["hit"])
        span = F.array(F.struct(low.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), high.alias("end")))
        more = F.when(keep(x["part"]), span).otherwise(none) if keep else span
        return F.struct(high.alias("at"), F.concat(acc["out"], more).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def random_samples(spark: SparkSession, n: int = TRAIN_RANDOM) -> DataFrame:
    """(token): strings labelled random: base64 of digests, of 40 characters."""
    return spark.range(n).select(F.substring(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), 1, 40).alias("token"))


def ordinary_samples(docs: DataFrame, n_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(token): strings labelled ordinary: all words of the texts and their joins by _ . - / =, from a bounded set of documents chosen by hash."""
    ids = docs.filter("text <> ''").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_documents)
    words = F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.length(w) >= 2)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(words.alias("words"))  # at most n_documents rows
    places = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    # Six words a join, the five separators in turn; a place's own separator comes before it.
    pieces = F.transform(places, lambda x: F.concat(F.when(x["i"] % 6 == 0, " ").otherwise(F.substring(F.lit("_.-/="), (F.floor(x["i"] / 6) % 5 + 1).cast("int"), F.lit(1))), x["w"]))
    joins = F.split(F.ltrim(F.array_join(pieces, "")), " ")
    return chosen.select(F.explode(F.concat("words", joins)).alias("token")).filter("length(token) >= 2")


def transition_counts(samples: DataFrame) -> DataFrame:
    """(pair, n): how often a character follows another in the samples' tokens."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    return samples.filter("length(token) >= 2").select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(random: DataFrame, ordinary: DataFrame, smooth: float = 0.5, weight: float = 10.0) -> list[float]:
    """For each pair of CHARS, in order: log P(second | first, random) - log P(second | first, ordinary)."""
    size = len(CHARS)
    at = {c: i for i, c in enumerate(CHARS)}
    tables = []
    for samples in (random, ordinary):
        counts = [[0.0] * size for _ in range(size)]
        for pair, n in transition_counts(samples).filter(F.col("pair").rlike("^[A-Za-z0-9+/_.=-]{2}$")).collect():  # at most len(CHARS) squared rows
            counts[at[pair[0]]][at[pair[1]]] += n
        seen = [smooth + sum(row[i] for row in counts) for i in range(size)]
        alone = [x / sum(seen) for x in seen]
        tables.append([[math.log((x + weight * p) / (sum(row) + weight)) for x, p in zip(row, alone)] for row in counts])
    return [a - b for row, other in zip(*tables) for a, b in zip(row, other)]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's transitions (0 for under two characters)."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(CHARS), F.substring(token, i, F.lit(1))) - 1
    one = lambda i: F.coalesce(F.get(table, place(i) * len(CHARS) + place(i + 1)), F.lit(0.0))
    n = F.length(token) - 1
    return F.when(n < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + one(i)) / n)


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``base`` and ``spans``: array<struct<start int, kind int, end int>>, kind being a place in KINDS.

    base has the fixed patterns' spans, by start and kind; spans also has those that
    the models add. A null text counts as empty; columns named base or spans, or
    beginning with ``__``, give way; repeated rows stay.
    """
    kept = [c for c in docs.columns if c.lower() not in {"base", "spans"} and not c.startswith("__")]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(spans(text, ASSIGN, "assign", lambda part: F.length(part) >= 12), spans(text, ACCESS, "access"), spans(text, HEX, "hex")))
    tokens = spans(text, CANDIDATE, "markov")
    flagged = F.filter(tokens, lambda s: mean_ratio(F.substring(text, s["start"] + 1, s["end"] - s["start"]), ratios) > threshold)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], base.alias("base"), flagged.alias("__more"))
    return rows.withColumn("spans", F.array_sort(F.concat("base", "__more"))).drop("__more")


def joined(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    docs = docs.select("doc_id", "text")
    found = scan(docs, log_ratios(random_samples(docs.sparkSession), ordinary_samples(docs)))
    count = lambda column, kind: F.size(F.filter(column, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count("base", k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("spans", "markov"))
