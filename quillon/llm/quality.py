"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good (1) or bad (0). Its features are character and word shares of its
own, and some of the lines before and after it. The chain's forward-backward marginals,
weighted by line length, give the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import discard, drop_clashing, release_memory, settle, small_batches

#: Trained on at most so many labelled documents (whole texts), chosen by a hash of the id, and on so many bytes of features.
TRAIN_DOCUMENTS, TRAIN_BYTES = 4000, 256 << 20
ROUNDS = 150
PENALTY = 1e-3
PREDICT_FROM = 0.3
#: Characters whose features are worked out at once.
CHUNK_CHARS = 2_000_000
KINDS = 8  # space, letter, capital, digit, stop, bar, exclamation mark, other


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    out = np.full(0x110000, 7, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isspace():
            out[code] = 0
        elif c.isalpha():
            out[code] = 2 if c.isupper() else 1
        elif c.isdigit():
            out[code] = 3
    for c, kind in ((".", 4), (",", 4), ("|", 5), ("!", 6)):
        out[ord(c)] = kind
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts (one row each), their lengths, and how many lines each text has."""
    lines = [line for text in texts for line in text.split("\n")]
    per_text = np.array([text.count("\n") + 1 for text in texts])
    length = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(lines)), length)
    count = np.bincount(of * KINDS + kinds()[codes], minlength=len(lines) * KINDS).reshape(-1, KINDS).astype(np.float64)
    words = np.empty((len(lines), 3))
    for i, line in enumerate(lines):
        w = line.split()
        words[i] = len(w), len(set(w)), sum(map(str.__eq__, w, w[1:]))
    n, alpha, n_words = np.maximum(length, 1), count[:, 1] + count[:, 2], np.maximum(words[:, 0], 1)
    symbols, capitals, digits = count[:, 7] / n, count[:, 2] / np.maximum(alpha, 1), count[:, 3] / n
    bars, shouts = np.minimum(count[:, 5] / n_words, 1), np.minimum(count[:, 6] / n_words, 1)
    repeats, echoes = 1 - words[:, 1] / n_words, words[:, 2] / n_words
    few = n_words < 4
    own = np.column_stack(
        [
            symbols, capitals, digits, bars, shouts, repeats, echoes,
            np.log1p(words[:, 0]) / 5, np.minimum(alpha / n_words / 10, 3), np.minimum(count[:, 4] / n_words, 1), words[:, 0] == 0,
            symbols > 0.03, symbols > 0.1, (capitals > 0.3) & ~few, (capitals > 0.7) & ~few, repeats > 0.3, repeats > 0.6, echoes > 0.2, bars > 0.2, shouts > 0.2, few,
        ]
    )
    some = own[:, [0, 1, 3, 4, 5, 6, 10]]
    ends = np.cumsum(per_text)
    first, last = np.zeros((len(lines), 1)), np.zeros((len(lines), 1))
    first[ends - per_text], last[ends - 1] = 1, 1
    before, after = np.roll(some, 1, 0) * (1 - first), np.roll(some, -1, 0) * (1 - last)
    return np.hstack([np.ones((len(lines), 1)), own, before, after, first, last]).astype(np.float32), length, per_text


@dataclass(frozen=True)
class Chain:
    """weights: of features for a line being good; steps: 2 x 2, of a line's label and the next one's."""

    weights: np.ndarray
    steps: np.ndarray


def forward_backward(good: np.ndarray, per_text: np.ndarray, steps: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each line's marginal of being good, from its log-odds; and the expected label pairs, 2 x 2, over all texts (each by its weight).

    Texts of similar length go through the chain side by side.
    """
    out, pairs = np.empty(len(good)), np.zeros((2, 2))
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(per_text, kind="stable")
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and per_text[order[upto]] <= max(8, 1.3 * per_text[order[at]]) and (upto - at) * per_text[order[upto]] < 400_000:
            upto += 1
        own = order[at:upto]
        n, longest = per_text[own], per_text[own[-1]]
        place = starts[own][:, None] + np.minimum(np.arange(longest), n[:, None] - 1)
        inside = np.arange(longest) < n[:, None]
        emit = np.zeros((len(own), longest, 2))
        emit[:, :, 1] = good[place]
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + steps[0], alpha[:, t - 1, 1:] + steps[1]) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            x = emit[:, t + 1] + beta[:, t + 1]
            x = np.logaddexp(x[:, :1] + steps[:, 0], x[:, 1:] + steps[:, 1])
            beta[:, t] = np.where(inside[:, t + 1, None], x, 0)
        whole = np.logaddexp(*(alpha[np.arange(len(own)), n - 1]).T)
        marginal = np.exp(alpha[:, :, 1] + beta[:, :, 1] - whole[:, None])
        out[place[inside]] = np.clip(marginal[inside], 0, 1)
        if longest > 1:
            joint = alpha[:, :-1, :, None] + steps + (emit + beta)[:, 1:, None, :] - whole[:, None, None, None]
            each = inside[:, 1:] if weight is None else inside[:, 1:] * weight[own][:, None]
            pairs += np.einsum("nt,ntij->ij", each, np.where(inside[:, 1:, None, None], np.exp(np.minimum(joint, 0)), 0))
        at = upto
    return out, pairs


def train(x: np.ndarray, per_text: np.ndarray, quality: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Chain:
    """Penalised maximum likelihood by Adam; every line has its document's label. A text's likelihood counts by one over its lines, so texts count alike."""
    x = x.astype(np.float64, copy=False)
    y = np.repeat(quality, per_text).astype(np.float64)
    weight = 1 / per_text / max(1, len(per_text))
    share = np.repeat(weight, per_text)
    theta = np.zeros(x.shape[1] + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.zeros((2, 2))
    np.add.at(inner, (quality, quality), weight * (per_text - 1))
    for i in range(1, rounds + 1):
        steps = theta[-4:].reshape(2, 2)
        p, pairs = forward_backward(x @ theta[:-4], per_text, steps, weight)
        slope = np.concatenate([x.T @ (share * (y - p)), (inner - pairs).ravel()]) - penalty * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.15 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -1.5, 1.5)  # one label a document would drive these without bound
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


def score_texts(texts: list[str], chain: Chain) -> np.ndarray:
    """The mean marginal of the lines of each text, weighted by their length (1 at least)."""
    out, low = np.empty(len(texts)), 0
    while low < len(texts):
        high, chars = low, 0
        while high < len(texts) and (high == low or chars + len(texts[high]) <= CHUNK_CHARS):
            chars += len(texts[high])
            high += 1
        x, length, per_text = line_features(texts[low:high])
        p, _ = forward_backward(x @ chain.weights, per_text, chain.steps)
        weight = np.maximum(length, 1)
        ends = np.cumsum(per_text)
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])])
        out[low:high] = total(p * weight) / total(weight)
        low = high
    return np.clip(out, 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Chain:
    """A chain trained on at most ``most`` documents with a label that aren't held out.

    Rows of labels without an id or a label of 0 or 1 count for nothing, and the rows of an
    id that several labels contradict. Without any labelled document every line is good by even odds.
    """
    small_batches(docs.sparkSession)
    release_memory()  # what was collected before
    usable = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__q")).filter("quality = __q").drop("__q")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `most` ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, quality, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quality", "text"))):
                x, _, per_text = line_features([text])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], batch.schema.field("doc_id").type), "quality": pa.array([quality], pa.int32()), "n": pa.array(per_text, pa.int64()), "x": [x.tobytes()]})

    kinds_ = [docs.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("x", T.BinaryType())]
    # One row of an id, whatever repeats, and of those the first by hash that fit: at most `most` rows and TRAIN_BYTES come to the driver.
    found = settle(texts.mapInArrow(features, T.StructType(kinds_)).groupBy("doc_id").agg(F.min(F.struct("x", "n", "quality")).alias("r")).select("doc_id", "r.*"))
    upto = F.sum(F.octet_length("x")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = found.withColumn("upto", upto).filter(F.col("upto") <= TRAIN_BYTES).drop("upto").collect()
    discard(found)
    got = sorted(got, key=lambda r: (r.doc_id, r.x))
    width = line_features([""])[0].shape[1]
    if not got:
        return Chain(np.zeros(width), np.zeros((2, 2)))
    per_text, quality = np.array([r.n for r in got]), np.array([r.quality for r in got])
    x = np.empty((per_text.sum(), width))  # in double precision at once, and the rows go: they aren't held a second time in training
    at = len(x)
    while got:
        own = np.frombuffer(got.pop().x, np.float32).reshape(-1, width)
        x[at - len(own) : at] = own
        at -= len(own)
    chain = train(x, per_text, quality)
    del x
    release_memory()
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with ``score`` (0 to 1); a null text counts as empty, columns named score give way, repeated rows stay."""
    small_batches(docs.sparkSession)
    rows = drop_clashing(docs, ["score"])
    out = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(texts, chain), pa.float64())], names=out.names)

    return rows.mapInArrow(scored, out)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from a score of PREDICT_FROM)."""
    done = score(docs.select("doc_id", "text"), fit(docs, labels))
    return done.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
