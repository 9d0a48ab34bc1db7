"""Byte-level BPE encoding and decoding.

Distinct words are encoded once, by Spark's higher-order functions: a fold over
the word's byte array merges, step by step, the adjacent pair of lowest rank, found
in a table of one row. Texts then look their words up. Decoding concatenates the
tokens' binary pieces.

The rank map is an array of small buckets by a hash of the pair, since a
Spark map finds a key by going through all its entries. It is built by an executor and stands
in the plan as a scalar subquery, so that the driver never parses, prints or logs it.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import count_of, discard, settle, small_batches

#: A word of more bytes is folded in Python by the same merges: the fold's steps grow with the square of the length.
LONG_WORD = 256
#: The dictionary is broadcast up to so many bytes; beyond, texts and their words meet in buckets by shuffle.
BROADCAST_BYTES = 160 << 20
#: Different chunks and words that a task remembers, so as not to handle them again.
SEEN = 200_000
#: Bytes of texts that are split at once.
BATCH_BYTES = 16 << 20
#: White space, for Arrow's regular expressions.
SPACE = "\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}"
#: Marks that are neither letters, digits nor white space; no apostrophe, as words may begin with one.
MARKS = ".,;:!?*#$%&()[]{}|/+=<>~^_-"
#: Words of a task of the fold, and of what the driver takes in at once of the dictionary.
FOLD_WORDS, PACK_WORDS = 50_000, 400_000
#: Text bytes of a bucket when the dictionary is too large to broadcast.
BUCKET_BYTES = 32 << 20
BASE = 1 << 17  # a token id is less
SLOTS = 1 << 17  # of the pair table
ID = 1 << 41  # added to ids, to tell them from ranks


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def pair_slots(path: str) -> list[list[int | None]]:
    """SLOTS lists. One with pairs has null first, then -1 - left and the merged id of each pair (left, right) there.

    A pair's slot and left tell its right. What is found at place 0, where a pair is missing, is null.
    """
    ranks = read_ranks(path)
    if max(ranks.values()) >= BASE - 1:
        raise ValueError(f"ids must be below {BASE - 1}")
    slots: list[list[int | None]] = [[] for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                slot = slots[(left << 7 ^ left >> 9 ^ right) & SLOTS - 1]
                slot += [-1 - left, rank] if slot else [None, -1 - left, rank]
    return slots


def rank_tables(spark: SparkSession, path: str) -> DataFrame:
    """One row: pairs (array<array<bigint>>: pair_slots) and singles (array<bigint>: the ids of the bytes), settled."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        for _ in batches:
            columns = [pa.array([pair_slots(path)], pa.list_(pa.list_(pa.int64()))), pa.array([[ranks[bytes([b])] for b in range(256)]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["pairs", "singles"])

    return settle(spark.range(0, 1, 1, 1).mapInArrow(tables, "pairs array<array<bigint>>, singles array<bigint>"))


def _let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def fold_merges(word: str, tables: str) -> Column:
    """The ids of a word given as its array of bytes (a column's name), by ranked merges; tables: a column of structs (a name), the row of rank_tables().

    The fold's state is one array: ids (from ID up), and between two ids the rank of their
    pair (null where it is no token); an id that merges with nothing stands at each end.
    So the least element is the pair to merge, and its rank is the new id. A step takes the
    leftmost such pair and looks up the two pairs that arise.

    It is written as SQL text: the parser's expressions evaluate faster than those
    that the Column functions build.
    """
    edge, rest, mask = ID + BASE - 1, 1 << 20, BASE - 1

    def rank(left: str, right: str) -> str:
        slot = f"get(t.pairs, cast((shiftleft({left}, 7) ^ shiftright({left}, 9) ^ {right}) & {SLOTS - 1} as int))"
        return f"get({slot}, cast(array_position({slot}, -1L - {left}) as int))"

    best, before, after = "get(s, at - 1)", f"(get(s, at - 4) & {mask})", f"(get(s, at + 2) & {mask})"
    merged = f"concat(slice(s, 1, at - 3), array({rank(before, best)}, {best} | {ID}L, {rank(best, after)}), slice(s, at + 3, {rest}))"
    step = _let("at", "cast(array_position(s, array_min(s)) as int)", f"if({best} >= {ID}L, s, {merged})")
    singles = f"concat(array({BASE - 1}L), transform({word}, x -> get(t.singles, x)), array({BASE - 1}L))"
    pairs = f"flatten(zip_with(slice(x, 1, size(x) - 1), slice(x, 2, {rest}), (l, r) -> array({rank('l', 'r')}, r | {ID}L)))"
    start = _let("x", singles, f"concat(array({edge}L), {pairs})")
    folded = f"aggregate({word}, {start}, (s, _) -> {step}, s -> transform(filter(s, x -> x >= {ID}L and x < {edge}L), x -> cast(x & {mask} as int)))"
    return F.expr(_let("t", tables, folded))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word: a heap of pairs, so n log n instead of the fold's square."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))  # by a piece's start
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid], end[i], after[i] = False, stop, after[mid]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Splitter:
    """Splits texts by the pattern, with each different chunk between single spaces split once.

    A match of such a pattern can hold a space only as its first character (or as one of
    a run of white space), so a space between two characters that aren't white space
    always begins a match, and what stands left of it has no part in what follows. Texts
    with other spaces are split whole. A pattern not known to be of this kind is
    always applied to whole texts.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.chunked = " ?\\p{L}+" in pattern and " ?[^\\s\\p{L}\\p{N}]+" in pattern and pattern.endswith("|\\s+(?!\\S)|\\s+")

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
        """Codes of the texts' chunks one after another, the different first chunks of texts (codes from 0), the different other
        ones without the space that each begins with (codes after those), and where each text's codes begin (and the last end)."""
        if self.chunked:
            rest = pc.if_else(pc.match_substring_regex(texts, f" [{SPACE}]|[{SPACE}] "), "", texts)
            split = pc.split_pattern(rest, " ")
            begin = split.offsets.to_numpy() - split.offsets[0].as_py()
            every = split.flatten()
            is_first = np.zeros(len(every), bool)
            is_first[begin[:-1]] = True
            more = every.filter(pa.array(~is_first)).dictionary_encode()
            firsts = pc.if_else(pc.equal(rest, ""), texts, every.filter(pa.array(is_first))).dictionary_encode()
        else:
            begin = np.arange(len(texts) + 1)
            is_first = np.ones(len(texts), bool)
            firsts, more = texts.dictionary_encode(), pa.array([], pa.string()).dictionary_encode()
        codes = np.empty(len(is_first), np.int32)
        codes[is_first] = firsts.indices.to_numpy()
        codes[~is_first] = more.indices.to_numpy() + len(firsts.dictionary)
        return codes, firsts.dictionary.to_pylist(), more.dictionary.to_pylist(), begin

    def words(self, firsts: list[str], rests: list[str]) -> tuple[list[str], list[int]]:
        """The matches in the first chunks and in the others (with their space), and how many each has."""
        out: list[str] = []
        counts: list[int] = []
        for chunk in firsts:
            found = self.find(chunk)
            out += found
            counts.append(len(found))
        for rest in rests:
            if rest.isalpha():  # the usual case: letters alone
                out.append(" " + rest)
                counts.append(1)
                continue
            head = rest.rstrip(MARKS)
            if head.isalpha():  # and letters with marks after them
                out.append(" " + head)
                out.append(rest[len(head) :])
                counts.append(2)
            else:
                found = self.find(" " + rest)
                out += found
                counts.append(len(found))
        return out, counts


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with up to ``most`` bytes in the column (or of one row)."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def distinct_words(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(word binary): each different match of pattern in the texts, once. A task splits each different chunk once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, chunks, seen = Splitter(pattern), set(), set()
        for batch in batches:
            for part in slices(batch, "text"):
                _, firsts, rests, _ = splitter.parts(part.column(0))
                if len(chunks) > SEEN or len(seen) > SEEN:
                    chunks, seen = set(), set()
                new = set(rests) - chunks
                found = set(splitter.words(firsts, list(new))[0]) - seen
                chunks.update(x for x in new if len(x) < LONG_WORD)
                seen.update(x for x in found if len(x) < LONG_WORD)
                yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in found], pa.binary())], ["word"])

    return docs.select(F.col(text).cast("string").alias("text")).filter("text <> ''").mapInArrow(split, "word binary").distinct()


def dictionary(words: DataFrame, path: str, ranks: DataFrame) -> DataFrame:
    """(word, ids array<int>) of distinct words, with the tables ``ranks``: the fold, and for words of over LONG_WORD bytes the same merges by a heap."""

    def by_heap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = read_ranks(path)
        for batch in batches:
            ids = [merge_long(w.as_py(), known) for w in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            flat = np.frombuffer(b"".join(words.to_pylist()), np.uint8).astype(np.int32)
            ends = np.cumsum([0, *map(len, words.to_pylist())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([words, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["word", "bytes"])

    view = f"ranks_{uuid.uuid4().hex}"
    ranks.createTempView(view)
    try:  # its name is read at once
        short = words.filter(F.octet_length("word") <= LONG_WORD).mapInArrow(bytes_of, "word binary, bytes array<int>")
        # A subquery may not be written in a higher-order function, but the optimizer puts it there: no row ever holds the tables.
        short = short.select("word", "bytes", F.expr(f"(select struct(pairs, singles) from {view})").alias("ranks")).select("word", fold_merges("bytes", "ranks").alias("ids"))
    finally:
        words.sparkSession.catalog.dropTempView(view)
    return short.unionByName(words.filter(F.octet_length("word") > LONG_WORD).mapInArrow(by_heap, "word binary, ids array<int>"))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decode_too: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with ``ids`` (binary: little-endian unsigned 32-bit integers) and, if asked for, ``decoded`` (binary) in place of the text.

    docs: any columns; those named text, ids or decoded, and any from ``__``, give
    way. A null text counts as empty; an empty text has no ids. Repeated rows stay.
    The ids are those of the rank file at ``path`` applied to each match of
    ``pattern`` on its own.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    plain = settle(distinct_words(docs, pattern, text))
    # Dealt evenly beforehand, so that no exchange stands in the fold's own plan.
    even = settle(plain.repartition(count_of(plain.count(), FOLD_WORDS)))
    discard(plain)
    ranks = rank_tables(spark, path)
    words = settle(dictionary(even, path, ranks))
    discard(even)
    discard(ranks)
    n, n_ids, most = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.max(F.array_max("ids")), F.lit(0))).first()
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), "ids", "decoded"} and not c.startswith("__")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    fields = [f for f in rows.schema if f.name != "__text"]
    out = T.StructType([*fields, T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * decode_too])

    def applied(batch: pa.RecordBatch | pa.Table, look_up) -> pa.RecordBatch:
        """look_up: the ids (binary array) of different words."""
        splitter = Splitter(pattern)
        codes, firsts, rests, begin = splitter.parts(batch.column("__text"))
        words, counts = splitter.words(firsts, rests)
        own = pa.array(words, pa.string()).dictionary_encode()
        of_words = look_up(own.dictionary.to_pylist()).take(own.indices)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        of_chunks = rebound(of_words, ends)
        coded = rebound(of_chunks.take(pa.array(codes)), begin)
        columns = [*[batch.column(f.name) for f in fields], coded]
        if decode_too:
            columns.append(pieces_of(coded, path))
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    if n * 12 + n_ids * 4 <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(_packed(words, n, n_ids, most))
        discard(words)

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, starts, ids = shared.value

            def look_up(own: list[str]) -> pa.Array:
                at = np.searchsorted(hashes, np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in own), np.uint64, len(own)).view(np.int64))
                low = starts[at].astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(starts[at + 1] - low)])
                flat = ids[np.repeat(low - ends[:-1], np.diff(ends)) + np.arange(ends[-1])].astype("<u4")
                return binary(ends * 4, pa.py_buffer(flat.tobytes()))

            for batch in batches:
                for part in slices(batch, "__text"):
                    yield applied(part, look_up)

        return rows.mapInArrow(by_broadcast, out)

    total = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    buckets = count_of(total, BUCKET_BYTES)
    # By all columns that can be hashed, so that copies of a text don't all meet in one bucket.
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*hashed), F.lit(buckets)))

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern)
        for batch in batches:
            by = batch.column("__bucket").to_numpy()
            for bucket in np.unique(by):
                _, firsts, rests, _ = splitter.parts(batch.column("__text").filter(pa.array(by == bucket)))
                words = [w.encode() for w in set(splitter.words(firsts, rests)[0])]
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(words), pa.int64()), pa.array(words, pa.binary())], ["__bucket", "word"])

    by_bucket = dealt.select("__bucket", "__text").mapInArrow(own_words, "__bucket bigint, word binary").distinct().join(words, "word")

    def by_shuffle(texts: pa.Table, own: pa.Table) -> pa.Table:
        found = {w.decode(): np.array(x, "<u4").tobytes() for w, x in zip(own.column("word").to_pylist(), own.column("ids").to_pylist())}
        look_up = lambda ws: pa.array([found[w] for w in ws], pa.binary())
        done = [applied(part, look_up) for batch in texts.combine_chunks().to_batches() for part in slices(batch, "__text")]
        return pa.Table.from_batches(done)

    return dealt.groupBy("__bucket").cogroup(by_bucket.groupBy("__bucket")).applyInArrow(by_shuffle, out)


def binary(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """A binary array by where its values begin (and the last ends) in data."""
    if ends[-1] >= 1 << 31:
        raise ValueError("over 2 GB in a batch")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data])


def rebound(parts: pa.Array, begin: np.ndarray) -> pa.Array:
    """The parts of an array without offset, joined: value i is made of parts begin[i] to begin[i + 1]."""
    data = parts.buffers()[2] or pa.py_buffer(b"")
    return binary(np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1)[begin] if len(parts) else np.zeros(len(begin), np.int32), data)


def pieces_of(coded: pa.Array, path: str) -> pa.Array:
    """The tokens' pieces of arrays of ids (little-endian, 32 bits), concatenated. Unknown ids raise."""
    if not len(coded):
        return coded
    ends = np.frombuffer(coded.buffers()[1], np.int32, len(coded) + 1, 4 * coded.offset)
    ids = np.frombuffer(coded.buffers()[2] or b"", "<u4", (ends[-1] - ends[0]) // 4, ends[0])
    pieces = piece_array(path).take(pa.array(ids, pa.uint32()))
    if pieces.null_count:
        raise ValueError("unknown id")
    return rebound(pieces, (ends - ends[0]) // 4)


@lru_cache(2)
def piece_array(path: str) -> pa.Array:
    found = {i: piece for piece, i in read_ranks(path).items()}
    return pa.array([found.get(i) for i in range(max(found) + 1)], pa.binary())


def _packed(words: DataFrame, n: int, n_ids: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dictionary as sorted hashes of words, where the ids of each begin (and the last end), and the ids; its size has been checked.

    It is sorted and packed on the executors, a row for each partition, and comes row by row, so
    that the driver holds it once.
    """

    kind = np.uint16 if most < 1 << 16 else np.uint32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[bytes]] = [[], [], []]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids")
            for x, own in zip((batch.column("h").to_numpy(), np.diff(ids.offsets.to_numpy()).astype(np.uint32), ids.flatten().to_numpy().astype(kind)), got):
                own.append(x.tobytes())
        if got[0]:
            low = int(np.frombuffer(got[0][0], np.int64)[0])
            yield pa.RecordBatch.from_arrays([pa.array([low]), *[pa.array([b"".join(x)], pa.binary()) for x in got]], ["low", "h", "n", "ids"])

    hashes, starts, ids = np.empty(n, np.int64), np.zeros(n + 1, np.uint32), np.empty(n_ids, kind)
    by_hash = words.select(F.xxhash64("word").alias("h"), "ids").repartitionByRange(count_of(n, PACK_WORDS), "h").sortWithinPartitions("h")
    rows = settle(by_hash.mapInArrow(pack, "low long, h binary, n binary, ids binary"))
    files: list[list[str]] = []
    room = 0
    for r in rows.select("low", F.octet_length("n").alias("size"), F.input_file_name().alias("file")).orderBy("low").collect():  # a row for each partition
        if r.size > room:
            files.append([])
            room = 4 * PACK_WORDS
        files[-1].append(r.file)
        room -= r.size
    at = id_at = 0
    for some in files:
        for r in sorted(words.sparkSession.read.schema(rows.schema).parquet(*some).collect(), key=lambda r: r.low):
            length = np.frombuffer(r.n, np.uint32)
            hashes[at : at + len(length)] = np.frombuffer(r.h, np.int64)
            ends = id_at + np.cumsum(length, dtype=np.int64)
            starts[at + 1 : at + 1 + len(length)] = ends
            ids[id_at : ends[-1]] = np.frombuffer(r.ids, kind)
            at, id_at = at + len(length), int(ends[-1])
    discard(rows)
    if at != n or id_at != n_ids or (hashes[1:] <= hashes[:-1]).any():
        raise ValueError("two words share a 64-bit hash")
    return hashes, starts, ids


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded`` (binary): the tokens' pieces, concatenated. Null ids decode to nothing; unknown ids raise."""
    out = T.StructType([*[f for f in df.schema if f.name != "decoded"], T.StructField("decoded", T.BinaryType())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ids):
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in out.names[:-1]], pieces_of(part.column(ids).fill_null(b""), path)], names=out.names)

    return df.mapInArrow(pieces, out)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(docs.select("doc_id", "text"), path, pattern, decode_too=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
