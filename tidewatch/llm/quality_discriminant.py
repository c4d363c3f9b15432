"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text gives :data:`FEATURES`: sizes as logarithms, shares as square roots (both tame
long tails), means as logarithms.  Spark sums the labelled rows' moments (count, sums,
sums of products) for each label and fold; everything else of the fit is made of these few
numbers.  Features are scaled by the pooled deviation.  A class covariance is shrunk twice,

    (1 - identity) ((1 - pooled) S_class + pooled S_pooled) + identity * trace / d * I,

and the two weights are the pair of a grid with the least log loss when each fold is scored
by the moments of the others.  A score starts from the log-density difference

    (M_0 - M_1 + log|C_0| - log|C_1|) / 2,

M being squared Mahalanobis distances by the Cholesky factors, which are made once and sent
to the tasks.  As normal densities are too sure of themselves, the difference passes through
a logistic line fitted to the folds' own differences, with the labels' shares as they are.

All labelled rows count, however many; what reaches the driver is moments (label, fold) and
the fold differences in at most :data:`BINS` bins for each pair of weights.  Labels are read
only where crc32(doc_id) mod 4 is not 2; label, language, source and id are never inputs.

Defined results: null text counts as empty; an empty text has a score like any other; texts
are read whole; of several labels of an id the smallest counts, null labels are ignored, each
row of a repeated id teaches; without rows of both labels every score is the share of label 1
(0 without labels); equal texts get equal scores; rows with a null doc_id are scored and are
not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_arrow, drop_stage, stage
from .toxicity import HELD_OUT, fold

FEATURES = (
    "words", "word_length", "word_length_spread", "long_words", "one_letter_words", "distinct_words", "repeated_triples", "top_word",
    "upper", "digits", "symbols", "marks", "exclamations", "pipes", "sentence_ends", "other_than_letters", "capital_words", "shouted_words",
    "lines", "line_length", "repeated_lines", "unended_lines", "packed_size",
)
#: Weights of the pooled covariance and of the identity that are tried.
GRID = [(p, i) for p in (0.0, 0.2, 0.5, 0.8, 0.95) for i in (0.001, 0.01, 0.05, 0.2)]
THRESHOLD = 0.7
#: Bins that fold differences are counted in, between -REACH and REACH.
BINS, REACH = 400, 50.0
_UPPER, _LOWER, _DIGITS = (bytes(range(ord(a), ord(z) + 1)) for a, z in ("AZ", "az", "09"))
_FIRST, _LATER = bytes(range(0xC0, 0xF8)), bytes(range(0x80, 0xC0))  # bytes of a code point beyond ASCII
_ENDS = (b".", b"!", b"?")
_SYMBOLS, _MARKS = b"#*$%&<>@^~\\{}[]=+", b",.;:?'\"()-"
_CAPITAL, _SHOUTED = re.compile(rb"(?<!\S)[A-Z][a-z]"), re.compile(rb"[A-Z]{2,}")
#: Bytes of a text that are packed at once.
PACKED = 1 << 16


def statistics(text: bytes) -> list[float]:
    """The features of one UTF-8 text; letters are ASCII letters and all code points beyond ASCII."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = lambda kind: size - len(text.translate(None, kind))
    share = lambda k, of: float(np.sqrt(max(0, k) / max(1, of)))
    chars = size - count(_LATER)
    upper = count(_UPPER)
    letters = upper + count(_LOWER) + count(_FIRST)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    packed = sum(len(zlib.compress(text[k : k + PACKED], 1)) for k in range(0, size, PACKED))
    return [
        float(np.log1p(n)), float(np.log(lengths.mean())), float(np.log1p(lengths.std())), share(int((lengths > 14).sum()), n), share(int((lengths == 1).sum()), n),
        share(len(counts), n), share(sum(k for k in triples.values() if k > 1), n), share(max(counts.values()), n),
        share(upper, letters), share(count(_DIGITS), size), share(count(_SYMBOLS), size), share(count(_MARKS), size), share(text.count(b"!"), size), share(text.count(b"|"), size),
        share(sum(map(text.count, (b". ", b".\n", b"? ", b"! "))), n), share(chars - letters - n, chars), share(len(_CAPITAL.findall(text)), n), share(len(_SHOUTED.findall(text)), n),
        float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), share(len(lines) - len(set(lines)), len(lines)), share(sum(not x.rstrip().endswith(_ENDS) for x in lines), len(lines)),
        float(np.log((packed + 20) / (size + 20))),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: the features of each text; the other columns pass through."""
    for batch in batches:
        found = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


@dataclass
class Moments:
    """Count, sums and sums of products of rows; moments of disjoint rows add up."""

    n: float
    s: np.ndarray
    p: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.p + other.p)

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        return cls(len(x), x.sum(axis=0), x.T @ x)

    @classmethod
    def none(cls) -> Moments:
        d = len(FEATURES)
        return cls(0, np.zeros(d), np.zeros((d, d)))

    def scatter(self) -> np.ndarray:
        return self.p - np.outer(self.s, self.s) / max(1, self.n)


class Discriminant:
    """Log-density difference of the two classes, label 1 against label 0, from their moments."""

    def __init__(self, zero: Moments, one: Moments, pooled: float, identity: float):
        within = zero.scatter() + one.scatter()
        self.scale = np.sqrt(np.maximum(np.diag(within) / (zero.n + one.n), 1e-8))
        common = within / (zero.n + one.n) / np.outer(self.scale, self.scale)
        self.means, self.factors = [], []
        for m in (zero, one):
            own = m.scatter() / m.n / np.outer(self.scale, self.scale)
            c = (1 - pooled) * own + pooled * common
            c = (1 - identity) * c + identity * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
            self.means.append(m.s / m.n / self.scale)
            self.factors.append(np.linalg.inv(np.linalg.cholesky(c)))

    def difference(self, x: np.ndarray) -> np.ndarray:
        half = []
        for mean, inverse in zip(self.means, self.factors, strict=True):
            z = (x / self.scale - mean) @ inverse.T
            half.append((z * z).sum(axis=1) / 2 - np.log(np.diag(inverse)).sum())  # log|C| / 2 is minus the logs of the inverse factor
        return half[0] - half[1]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: the moments of a task's rows, for each label and fold."""
    held: dict[tuple[int, int], Moments] = {}
    for batch in batches:
        x, label, part = _matrix(batch), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        for key in {*zip(label.tolist(), part.tolist(), strict=True)}:
            held[key] = held.get(key, Moments.none()) + Moments.of(x[(label == key[0]) & (part == key[1])])
    keys = sorted(held)
    flat = [[held[k].n, *held[k].s, *held[k].p.ravel()] for k in keys]
    yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["label", "fold", "m"])


def moments(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments of (label, fold, x), summed by Spark: one row for each label and fold reaches the driver."""
    d = len(FEATURES)
    parts = rows.select("label", "fold", "x").mapInArrow(_sums, "label int, fold int, m array<double>").select("label", "fold", F.posexplode("m").alias("at", "v"))
    summed = parts.groupBy("label", "fold", "at").agg(F.sum("v").alias("v")).groupBy("label", "fold").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m")).collect()
    out = {}
    for r in summed:
        v = np.array([m.v for m in r.m])
        out[r.label, r.fold] = Moments(v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return out


def _tried(models):
    """Kernel: for each fold's model and pair of weights, the labelled rows' differences counted in bins.  ``models``: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            x, label, part = _matrix(batch), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for held in set(part.tolist()):
                here = part == held
                for k, model in enumerate(models.value[held]):
                    at = bins(model.difference(x[here]))
                    counts[k] = counts.get(k, np.zeros(2 * BINS, dtype=np.int64)) + np.bincount(at + BINS * label[here], minlength=2 * BINS)
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array(np.full(len(at), k), pa.int32()), pa.array(at % BINS, pa.int32()), pa.array(at // BINS, pa.int32()), pa.array(c[at], pa.int64())], names=["k", "bin", "label", "n"])

    return run


def bins(difference: np.ndarray) -> np.ndarray:
    return np.clip(((difference + REACH) / (2 * REACH) * BINS).astype(np.int64), 0, BINS - 1)


def logistic_line(counts: np.ndarray) -> tuple[float, float, float]:
    """(slope, offset, log loss a row) of the logistic line through counts (label, bin), by Newton's method with a slight pull to slope 1, offset 0."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    n, ones = counts.sum(axis=0), counts[1]
    w, pull = np.array([1.0, 0.0]), 1.0
    design = np.stack([x, np.ones(BINS)])
    loss_of = lambda w: float((n * np.logaddexp(0, design.T @ w) - ones * (design.T @ w)).sum() + pull / 2 * ((w - [1, 0]) ** 2).sum())
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design.T @ w, -500, 500)))
        gradient = design @ (n * p - ones) + pull * (w - [1, 0])
        step = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + pull * np.eye(2), gradient)
        size, before = 1.0, loss_of(w)
        while size > 1e-6 and loss_of(w - size * step) > before:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), loss_of(w) / max(1, n.sum())


@dataclass
class Fitted:
    model: Discriminant | None
    slope: float
    offset: float
    weights: tuple[float, float] | None
    loss: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), self.offset)
        line = self.slope * np.clip(self.model.difference(x), -REACH, REACH) + self.offset
        return 1 / (1 + np.exp(-line))


def fit(rows: DataFrame) -> Fitted:
    """A discriminant fitted to (label, fold, x); folds are any small integers."""
    found = moments(rows)
    folds = sorted({f for _, f in found})
    total = lambda label, but=None: sum((m for (y, f), m in found.items() if y == label and f != but), Moments.none())
    zero, one = total(0), total(1)
    enough = all(total(y, f).n > 1 for y in (0, 1) for f in folds) and len(folds) > 1
    if not zero.n or not one.n:
        return Fitted(None, 0.0, float(one.n > 0), None, 0.0)
    if not enough:  # too few rows to hold some out: the heaviest shrinkage, and the plain log odds
        return Fitted(Discriminant(zero, one, *GRID[-1]), 1.0, float(np.log(one.n / zero.n)), GRID[-1], 0.0)
    models = {f: [Discriminant(total(0, f), total(1, f), *g) for g in GRID] for f in folds}
    tried = rows.select("label", "fold", "x").mapInArrow(_tried(rows.sparkSession.sparkContext.broadcast(models)), "k int, bin int, label int, n long")
    counts = np.zeros((len(GRID), 2, BINS))
    for r in tried.groupBy("k", "bin", "label").agg(F.sum("n").alias("n")).collect():  # at most GRID x BINS x 2 rows
        counts[r.k, r.label, r.bin] = r.n
    lines = [logistic_line(c) for c in counts]
    best = min(range(len(GRID)), key=lambda k: lines[k][2])
    return Fitted(Discriminant(zero, one, *GRID[best]), lines[best][0], lines[best][1], GRID[best], lines[best][2])


def _scored(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.round(fitted.value.score(_matrix(batch)), 9))], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; ``labels`` has doc_id and quality."""
    spark = docs.sparkSession
    measured = stage(binary_arrow(docs, "doc_id", "text").mapInArrow(_measured, "doc_id long, x array<double>"), "quality-features")
    part = fold(F.col("doc_id"))
    learn = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (part != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    rows = stage(measured.join(learn, "doc_id").select("label", part.cast("int").alias("fold"), "x"), "quality-labelled")
    fitted = fit(rows)
    drop_stage(rows)
    scored = measured.mapInArrow(_scored(spark.sparkContext.broadcast(fitted)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(part == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
