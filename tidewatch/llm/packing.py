"""Packing token sequences by non-negative least squares over shallow length combinations.

A document's ids (with the end id) are cut into whole windows and one rest of 1 to
``window - 1`` ids.  The histogram of rests has ``window - 1`` bins whatever the corpus
holds.  All combinations of two or three lengths that fill a window exactly are enumerated,
their repeat counts are solved against the histogram by non-negative least squares
(projected gradient with restarts), rounded down to what the histogram holds, and the
residual is packed greedily: first whole rests that fill a window exactly, then the rests
laid end to end and cut at window bounds; the last sequence is cut into powers of two.  So
no sequence has padding: each has ``window`` ids or a power of two of them.

The plan is made of runs (length, first rank, end rank, sequence, offset) on the driver,
bounded by the number of bins and combinations; a rest's rank among those of its length
comes from its table partition, so a hot length is dealt like any other.

Defined results: null or empty text is a document of one id, the end id; repeated rows, rows
that share a doc_id and rows without one are documents of their own, each with all its ids;
a very long text fills windows of its own and leaves one rest; ties between equally long
rests go by table partition and row; an empty table gives no pieces; other columns are ignored.
The vocabulary's text form of a special token is encoded as the tokenizer file says.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_arrow, stage

WINDOW = 1024
#: Distinct word forms whose ids a worker remembers.
MEMO_WORDS = 400_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a text by the public byte-level vocabulary, as little-endian unsigned 32-bit bytes.

    Words are encoded by the same vocabulary in its rank form and remembered; texts that
    name a special token go through the tokenizer file itself.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb"))}
        core = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file, self.whole = public_tokenizers.path(f"{vocabulary}.json"), None

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                ids = np.array(core.encode_ordinary(word), dtype="<u4").tobytes()
                if len(self) < MEMO_WORDS and len(word) < 64:
                    self[word] = ids
                return ids

        self.memo, self.words = Memo(), regex.compile(public_tokenizers.PATTERN).findall
        # Plain Latin texts: the same pattern with its classes written out, for the standard library's faster engine.
        import re

        letters, space = "A-Za-zÀ-ÖØ-öø-ÿ", r" \t-\r"
        self.plain = re.compile(f"[\\x00-\\x1b\\x20-\\x7e{letters}]*").fullmatch
        self.plain_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[0-9]+| ?[^{space}{letters}0-9]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def __call__(self, text: str) -> bytes:
        if "<|" in text and "|>" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = self.plain_words(text) if self.plain(text) else self.words(text)
        return b"".join(map(self.memo.__getitem__, words))


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def document_ids(text: bytes, vocabulary: str) -> bytes:
    return encoder(vocabulary)(text.decode()) + b"\0\0\0\0"


def _cut(window: int, vocabulary: str):
    """Kernel: for each document its token count, the CRC of each whole window and of the rest, and its places within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole, seen, last = TaskContext.get().partitionId(), 0, np.zeros(window, dtype=np.int64), (None, None)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if text != last[0]:
                    ids = document_ids(text, vocabulary)
                    last = text, (len(ids) // 4, [zlib.crc32(ids[k : k + 4 * window]) for k in range(0, len(ids), 4 * window)])
                n, crcs = last[1]
                rest = n % window
                out.append((n, crcs, rest, part, whole, int(seen[rest])))
                whole += n // window
                seen[rest] += 1
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64())))], names=["doc_id", "n", "crcs", "rest", "part", "whole_before", "rank"]) if out else pa.record_batch([batch.column(0).slice(0, 0), *(pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["doc_id", "n", "crcs", "rest", "part", "whole_before", "rank"])

    return run


def combinations(window: int) -> np.ndarray:
    """Rows of three lengths (0: none), falling, that fill the window: all pairs, then all triples."""
    pairs = [(a, window - a, 0) for a in range((window + 1) // 2, window)]
    triples = []
    for a in range(-(-window // 3), window - 1):
        low, high = (window - a + 1) // 2, min(a, window - a - 1)
        b = np.arange(low, high + 1)
        triples.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate([np.array(pairs), *triples]).astype(np.int64)


def solve_counts(histogram: np.ndarray, rows: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x that least-squares fits the histogram: sum of x over rows holding each length (accelerated projected gradient)."""
    window = len(histogram)
    h = histogram.astype(float)
    h[0] = 0

    def fit(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(rows[:, k], weights=x, minlength=window) for k in range(3))
        y[0] = 0
        return y

    use = np.all((h[rows] > 0) | (rows == 0), axis=1)
    x = z = np.zeros(len(rows))
    degree = fit(use.astype(float))
    step = 1.0 / max(1.0, 3.0 * degree.max())
    t = 1.0
    for _ in range(steps):
        residual = fit(z) - h
        gradient = sum(residual[rows[:, k]] for k in range(3)) * use
        new = np.maximum(0.0, z - step * gradient) * use
        if np.dot(z - new, new - x) > 0:  # restart the momentum where it points uphill
            t, z = 1.0, new
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t_next * (new - x), new, t_next
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, int]], int, int]:
    """Where each rest goes.

    Returns runs (length, first rank, end rank, first sequence, offset) of rests that stay
    whole, runs (length, first rank, end rank, first place) of rests laid end to end from
    place 0, the number of exact sequences and the ids laid end to end.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(window, dtype=np.int64)
    rows = combinations(window)
    runs, sequences = [], 0

    def take(lengths: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        place = 0
        for length in lengths:
            runs.append((int(length), int(used[length]), int(used[length]) + times, sequences, place))
            used[length] += times
            left[length] -= times
            place += int(length)
        sequences += times

    def fits(lengths: tuple[int, ...]) -> int:
        return min(int(left[a]) // lengths.count(a) for a in set(lengths))

    x = solve_counts(histogram, rows)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        lengths = tuple(int(a) for a in rows[k] if a)
        if (times := min(int(x[k]), fits(lengths))) > 0:
            take(lengths, times)
    for a in range(window - 1, window // 3, -1):  # greedy: the largest rests first, each with what fills its window
        if left[a] and left[window - a] and (times := fits((a, window - a))) > 0:
            take((a, window - a), times)
        while left[a]:
            b = np.arange(1, window - a)
            c = window - a - b
            good = np.flatnonzero((b >= c) & (b <= a) & (left[b] > 0) & (left[c] > 0))
            done = False
            for k in good[::-1]:
                lengths = (a, int(b[k]), int(c[k]))
                if (times := fits(lengths)) > 0:
                    take(lengths, times)
                    done = True
                    if not left[a]:
                        break
            if not done:
                break
    place, laid = 0, []
    for length in range(window - 1, 0, -1):
        if n := int(left[length]):
            laid.append((length, int(used[length]), int(used[length]) + n, place))
            place += n * length
    return runs, laid, sequences, place


def bounds(total: int, window: int) -> list[int]:
    """Starts of the last sequences of ids laid end to end: the tail past the last whole window, in powers of two."""
    at = total - total % window
    starts = []
    while at < total:
        starts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return starts


def _recut(window: int, total: int, first: int, vocabulary: str):
    """Kernel: pieces of documents whose rest is cut, with the CRC of each."""
    tail = bounds(total, window)
    base = total - total % window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = document_ids(text, vocabulary)
                n = len(ids) // 4
                start, stop = n - n % window, n
                while start < stop:
                    if place < base:
                        begin, sequence = place - place % window, first + place // window
                        end = begin + window
                    else:
                        k = max(j for j, b in enumerate(tail) if b <= place)
                        begin, sequence = tail[k], first + base // window + k
                        end = tail[k + 1] if k + 1 < len(tail) else total
                    length = min(stop - start, end - place)
                    out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, place - begin))
                    start, place = start + length, place + length
            names = [x.split()[0] for x in PIECE.split(", ")]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=names)

    return run


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    source = binary_arrow(docs, "doc_id", "text")
    cut = stage(source.mapInArrow(_cut(window, vocabulary), "doc_id long, n long, crcs array<long>, rest int, part int, whole_before long, rank long"), "pack-cut")
    by_part = cut.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n_docs"))
    histogram = np.zeros(window, dtype=np.int64)
    for r in by_part.groupBy("rest").agg(F.sum("n_docs").alias("n")).collect():  # a bin for each length below the window
        histogram[r.rest] = r.n
    runs, laid, exact, total = plan(histogram, window)
    whole_first = exact + total // window + len(bounds(total, window))
    before = by_part.withColumn("before", F.sum("n_docs").over(Window.partitionBy("rest").orderBy("part")) - F.col("n_docs")).drop("n_docs")
    # Whole windows: numbered part after part; one row for each part is scanned.
    wholes = cut.groupBy("part").agg(F.sum(F.floor(F.col("n") / window)).alias("w"))
    wholes = wholes.withColumn("part_first", F.sum("w").over(Window.orderBy("part")) - F.col("w")).drop("w")
    pieces = (
        cut.where(f"n >= {window}").join(wholes, "part")
        .select("doc_id", "n", (F.col("part_first") + F.col("whole_before") + whole_first).alias("first"), F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("n") / window).cast("int"))).alias("k", "ids_crc32"))
        .select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    rests = cut.where("rest > 0").join(before, ["part", "rest"]).withColumn("rank", F.col("rank") + F.col("before"))
    in_run = (F.col("rest") == F.col("run_rest")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    # The plan's runs are bounded by the number of combinations that the solution uses, whatever the corpus.
    plan_runs = F.broadcast(spark.createDataFrame(runs, "run_rest int, lo long, hi long, sequence long, offset long"))
    kept = rests.join(plan_runs, in_run).select(
        "doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset",
    )
    out = pieces.unionByName(kept)
    if laid:
        laid_runs = F.broadcast(spark.createDataFrame(laid, "run_rest int, lo long, hi long, place long"))
        cut_docs = rests.join(laid_runs, in_run).select(F.col("doc_id").alias("cut_id"), (F.col("place") + (F.col("rank") - F.col("lo")) * F.col("rest")).alias("place"), "part", "whole_before", "n", F.element_at("crcs", -1).alias("rest_crc"))
        out = out.unionByName(_cut_pieces(source, stage(cut_docs, "pack-laid"), window, total, exact, vocabulary))
    return out


def _cut_pieces(source: DataFrame, cut_docs: DataFrame, window: int, total: int, exact: int, vocabulary: str) -> DataFrame:
    """Pieces of the documents laid end to end; their ids are made again."""
    # Rows that share a doc_id are matched to their places in turn, by token count and CRC through the text's own.
    from .common import small

    numbered = cut_docs.withColumn("turn", F.row_number().over(Window.partitionBy("cut_id", "n", "rest_crc").orderBy("place")))
    laid = small(cut_docs.select(F.col("cut_id").alias("laid_id")).distinct())
    texts = source.join(laid, F.col("doc_id").eqNullSafe(F.col("laid_id")), "left_semi")  # a null doc_id is one too
    marked = texts.mapInArrow(_rest_crc(window, vocabulary), "cut_id long, text binary, n long, rest_crc long")
    marked = marked.withColumn("turn", F.row_number().over(Window.partitionBy("cut_id", "n", "rest_crc").orderBy("text")))
    numbered = numbered.withColumnRenamed("cut_id", "laid_id").select("laid_id", "n", "rest_crc", "turn", "place")
    placed = marked.withColumnsRenamed({"n": "made_n", "rest_crc": "made_crc", "turn": "made_turn"}).join(numbered, F.col("cut_id").eqNullSafe(F.col("laid_id")) & (F.col("made_n") == F.col("n")) & (F.col("made_crc") == F.col("rest_crc")) & (F.col("made_turn") == F.col("turn")))
    return placed.select("cut_id", "text", "place").mapInArrow(_recut(window, total, exact, vocabulary), PIECE)


def _rest_crc(window: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_ids(t, vocabulary) for t in batch.column(1).to_pylist()]
            ns = [len(x) // 4 for x in found]
            crcs = [zlib.crc32(x[4 * (n - n % window) :]) for x, n in zip(found, ns, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], names=["cut_id", "text", "n", "rest_crc"])

    return run
