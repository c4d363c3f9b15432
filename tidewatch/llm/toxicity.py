"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their prefixes of four letters (``prefix*``); every term of
every labelled example is in the vocabulary.  A term weighs ``(1 + log n) idf g``: ``idf``
counts documents over the whole corpus, and ``g`` is 1 plus how far (in standard deviations
beyond two, times the log odds) the labelled examples show it to go with one label.  Terms
that no example holds match nothing and only scale a text, so they are left out.

Examples are laid out in blocks; each term's posting list has the examples' weights and the
largest weight in each block.  The lists of terms that most blocks hold are kept as rows of
a matrix.  A query's bound for a block is what the matrix gives at most there plus the sum
of its other terms' largest weights; only blocks whose bound reaches the k-th best so far
are scored, so the nearest examples are exact.  Their votes are weighted by distance and by
how much rarer their label is in the labels than among the examples; a small prior keeps
scores off 0 and 1.  Evidence: the ids and similarities.

Bounded by a parameter: ``max_examples`` labelled rows of each label are used (chosen by a
hash of the id).  Labels are read only where crc32(doc_id) mod 4 is not 2; label, language,
source and id are never inputs of a score, ties included: equally near examples go by a
hash of their text, equal texts by their label, and what is then alike scores alike.

Defined results: null text counts as empty; a text without any term of the vocabulary gets
the labels' base rate; texts are read whole, however long; null labels are ignored, of
several labels of an id the largest counts, of several texts of an id the smallest; without
labels every score is 0; repeated rows get equal scores; rows with a null doc_id are scored
and are not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_arrow, drop_stage, small, stage

FOLDS, HELD_OUT = 4, 2
MAX_EXAMPLES = 1500
NEAREST, BLOCK = 15, 64
#: Terms that so many examples hold are rows of the matrix.
HEAVY = 48
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W\d_]+").findall
MEMO_WORDS = 300_000


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def terms_of(word: str) -> tuple[str, ...]:
    return (word, word[:4] + "*") if len(word) > 4 else (word,)


def _term_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: each distinct term of each example, with the example's label."""
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = sorted({t for w in set(WORDS(text.decode().lower())) for t in terms_of(w)})
            yield pa.record_batch([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["term", "label"])


def _vectors(vocabulary):
    """Kernel: term numbers and counts of each text; the other columns pass through.  ``vocabulary``: a broadcast list of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: k for k, t in enumerate(vocabulary.value)}
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            numbers, counts = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                own: dict[int, int] = {}
                for word, n in Counter(WORDS(text.decode().lower())).items():
                    hit = memo.get(word)
                    if hit is None:
                        hit = tuple(index[t] for t in terms_of(word) if t in index)
                        if len(memo) < MEMO_WORDS:
                            memo[word] = hit
                    for k in hit:
                        own[k] = own.get(k, 0) + n
                keys = sorted(own)
                numbers.append(keys)
                counts.append([own[k] for k in keys])
            yield pa.record_batch([*batch.columns[:-1], pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "terms", "counts"])

    return run


class Sparse:
    """Rows of (term, weight) one after the other; row k lies at ends[k] to ends[k + 1]."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ends, self.terms, self.weights = ends, terms, weights

    def __len__(self) -> int:
        return len(self.ends) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def take(self, order: np.ndarray) -> Sparse:
        at = _ranges(self.ends[:-1][order], np.diff(self.ends)[order])
        return Sparse(np.concatenate([[0], np.cumsum(np.diff(self.ends)[order])]), self.terms[at], self.weights[at])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[k], ..., starts[k] + sizes[k] - 1 for every k."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts, sizes) + np.arange(int(sizes.sum()))


def weigh(sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, term_weight: np.ndarray) -> Sparse:
    """Unit TF-IDF rows (an empty row where no term is known)."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    w = (1 + np.log(counts)) * term_weight[terms]
    square = np.concatenate([[0.0], np.cumsum(w * w)])
    norm = np.sqrt(np.maximum(square[ends[1:]] - square[ends[:-1]], 1e-30))
    return Sparse(ends, terms, (w / np.repeat(norm, sizes)).astype(np.float32))


class BlockMaxIndex:
    """Labelled unit vectors as posting lists over blocks of examples, with the largest weight of each term in each block."""

    def __init__(self, vectors: Sparse, n_terms: int, labels: np.ndarray, ids: np.ndarray, tie: np.ndarray, block: int = BLOCK, heavy: int = HEAVY):
        # Alike examples share a block: ordered by their heaviest term, then by what settles ties.
        n = len(vectors)
        heaviest = np.full(n, -1)
        by_weight = np.lexsort((vectors.terms, vectors.weights, vectors.rows()))
        heaviest[vectors.rows()[by_weight]] = vectors.terms[by_weight]
        order = np.lexsort((ids, labels, tie, heaviest))  # ids only order what is alike in text and label
        held = vectors.take(order)
        self.labels, self.ids, self.block = labels[order], ids[order], block
        self.n_blocks = -(-n // block)
        row, frequency = held.rows(), np.bincount(held.terms, minlength=n_terms)
        dense = frequency >= heavy
        self.column = np.where(dense, np.cumsum(dense) - 1, -1)  # of the matrix
        self.matrix = np.zeros((int(dense.sum()), self.n_blocks * block), dtype=np.float32)
        at = dense[held.terms]
        self.matrix[self.column[held.terms[at]], row[at]] = held.weights[at]
        term, example, weight = held.terms[~at], row[~at], held.weights[~at]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        self.ends = np.searchsorted(term, np.arange(n_terms + 1))
        key = term.astype(np.int64) * max(1, self.n_blocks) + self.example // block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.most_block = (self.example // block)[first]
        self.most_ends = np.searchsorted(term[first], np.arange(n_terms + 1))

    def _postings(self, queries: Sparse, row: np.ndarray, ends: np.ndarray, where: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, product) of the posting lists of the queries' other terms."""
        light = self.column[queries.terms] < 0
        terms, own = queries.terms[light], queries.weights[light]
        sizes = ends[terms + 1] - ends[terms]
        at = _ranges(ends[terms], sizes)
        return np.repeat(row[light], sizes), where[at].astype(np.int64), np.repeat(own, sizes) * weight[at]

    def nearest(self, queries: Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k nearest of each query, nearest first, exact; ties go to the smaller place."""
        n, width, k = len(queries), self.n_blocks * self.block, min(k, len(self.ids))
        if not k or not n:
            return np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.float32)
        row = queries.rows()
        heavy = self.column[queries.terms] >= 0
        asked = np.zeros((n, len(self.matrix)), dtype=np.float32)
        asked[row[heavy], self.column[queries.terms[heavy]]] = queries.weights[heavy]
        scores = asked @ self.matrix
        q, b, product = self._postings(queries, row, self.most_ends, self.most_block, self.most)
        bound = scores.reshape(n, self.n_blocks, self.block).max(axis=2) + np.bincount(q * self.n_blocks + b, product, n * self.n_blocks).reshape(n, self.n_blocks) + 1e-5
        q, e, product = self._postings(queries, row, self.ends, self.example, self.weight)

        def scored(blocks: np.ndarray) -> np.ndarray:
            """Whole scores in the marked blocks, -1 elsewhere."""
            inside = blocks[q, e // self.block]
            out = scores + np.bincount(q[inside] * width + e[inside], product[inside], n * width).reshape(n, width).astype(np.float32)
            out = np.where(np.repeat(blocks, self.block, axis=1), out, np.float32(-1))
            out[:, len(self.ids) :] = -1
            return out

        # The most promising blocks give a k-th best; only blocks that can reach it are scored.
        few = min(self.n_blocks, max(2, -(-2 * k // self.block)))
        start = np.zeros((n, self.n_blocks), dtype=bool)
        np.put_along_axis(start, np.argpartition(-bound, few - 1, axis=1)[:, :few], True, axis=1)
        kth = np.partition(scored(start), width - k, axis=1)[:, width - k]
        whole = scored(bound >= kth[:, None])
        # Order-preserving keys: the similarity's bits, then the smaller place.
        bits = np.maximum(whole, np.float32(0)).view(np.int32).astype(np.int64)
        key = np.where(whole < 0, np.int64(-1), (bits << 32) | (np.int64(1 << 31) - np.arange(width)))
        top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        return top, np.take_along_axis(whole, top, 1)


def votes(similarity: np.ndarray, labels: np.ndarray, ratio: float, base_rate: float) -> np.ndarray:
    """Distance-weighted share of label 1; ratio: the weight of a vote for label 1 against one for label 0."""
    weight = 1.0 / (1.05 - np.clip(similarity, 0.0, 1.0))
    ones, zeros = (weight * labels).sum(axis=1) * ratio, (weight * (1 - labels)).sum(axis=1)
    return (ones + 0.1 * base_rate) / (ones + zeros + 0.1)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _scored(index, base_rate: float, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, term_weight = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                queries = weigh(sizes, _flat(part, "terms"), _flat(part, "counts"), term_weight)
                place, similarity = held.nearest(queries, NEAREST)
                known = sizes > 0
                score = np.full(len(sizes), base_rate)
                if place.shape[1] and known.any():
                    score[known] = votes(similarity[known], held.labels[place[known]], ratio, base_rate)
                near = [held.ids[p].tolist() if k else [] for p, k in zip(place, known, strict=True)]
                likeness = [s.astype(float).tolist() if k else [] for s, k in zip(similarity, known, strict=True)]
                yield pa.record_batch([part.column("doc_id"), pa.array(score), pa.array(near, pa.list_(pa.int64())), pa.array(likeness, pa.list_(pa.float64()))], names=["doc_id", "score", "neighbours", "similarities"])

    return run


def label_weights(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Weight of terms that ``a`` of n1 examples of label 1 and ``b`` of n0 of label 0 hold: 1 where they tell nothing."""
    if not n1 or not n0:
        return np.ones(len(a))
    expected, share = (a + b) * n1 / (n1 + n0), n1 / (n1 + n0)
    z = (a - expected) / np.sqrt(expected * (1 - share))
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    return 1 + np.maximum(0, np.abs(z) - 2) * np.abs(odds)


def score_documents(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours and similarities of every row of ``docs``."""
    spark = docs.sparkSession
    learn = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    learn = stage(learn, "toxic-labels")
    base = {r.label: r.n for r in learn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [learn.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for y in (0, 1)]
    examples = small(stage(chosen[0].unionByName(chosen[1]), "toxic-chosen"))
    texts = docs.select("doc_id", "text").join(examples, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = stage(binary_arrow(texts, "doc_id", "label", "text"), "toxic-examples")
    n_example = {r.label: r.n for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n_example.get(1, 0), n_example.get(0, 0)
    counted = texts.select("text", "label").mapInArrow(_term_sets, "term string, label int").groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    found = counted.orderBy("term").toArrow()  # the terms of at most max_examples texts of each label
    words = spark.sparkContext.broadcast(found.column("term").to_pylist())
    vectors = stage(binary_arrow(docs, "doc_id", "text").mapInArrow(_vectors(words), "doc_id long, terms array<int>, counts array<int>"), "toxic-vectors")
    df = np.zeros(len(found))
    seen = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a number for each term
    df[seen.column("t").to_numpy()] = seen.column("n").to_numpy()
    idf = np.log((1 + vectors.count()) / (1 + df)) + 0.01
    term_weight = idf * label_weights(found.column("a").to_numpy().astype(float), found.column("b").to_numpy().astype(float), n1, n0)
    own = texts.select("doc_id", "label", F.xxhash64("text").alias("tie"), "text").mapInArrow(_vectors(words), "doc_id long, label int, tie long, terms array<int>, counts array<int>").toArrow().combine_chunks()
    batch = own.to_batches()[0] if own.num_rows else pa.record_batch([pa.array([], f.type) for f in own.schema], schema=own.schema)
    unit = weigh(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False), _flat(batch, "terms"), _flat(batch, "counts"), term_weight)
    index = BlockMaxIndex(unit, len(found), *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "doc_id", "tie")))
    drop_stage(learn, texts)
    total = sum(base.values())
    rate = base.get(1, 0) / total if total else 0.0
    ratio = (base.get(1, 0) / n1) / (base.get(0, 0) / n0) if n1 and n0 else 1.0
    scored = vectors.mapInArrow(_scored(spark.sparkContext.broadcast((index, term_weight)), rate, ratio), "doc_id long, score double, neighbours array<long>, similarities array<double>")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "similarities")
