"""Exact removal of repeated substrings by column-wise suffix ordering of many documents.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else.

Column-wise construction takes one symbol of every document a round, keeps the documents'
suffixes in order and updates the common prefixes of neighbours.  Over whole documents it
would need as many rounds as the longest document has bytes, each rewriting the transform;
so documents first give short aligned pieces.  Every window of ``length`` bytes has one
anchor, its leftmost least hashed ``K``-gram; equal windows have their anchor at the same
place.  Pieces (the windows of one anchor, at most ``2 length - K`` bytes) that occur
twice as a whole are repeated as a whole.  Pieces that share only the anchor's K-gram are
aligned at it and ordered column by column from the right: each round inserts one symbol
of every piece, a stable sort by symbol turns the order of the suffixes one column further
right into this column's, and the common prefix of neighbours is one more than the least
common prefix between them before.  A window is repeated where a neighbour's common prefix
reaches ``length``.  Groups with more than ``GROUP`` distinct pieces are instead counted
window by window, which needs no group in one place.

Anchors, pieces and windows are matched by 64-bit hashes of their bytes, ordered pieces by
the bytes themselves.

Defined results: null or empty text keeps the SHA-256 of nothing; texts shorter than
``length`` lose nothing; repeated rows lose all that their copies share; repeats may
overlap and lie in one document; very long texts are searched in segments that overlap by a
window, so nothing between them is missed; a null doc_id stays null (rows are told apart by
their place); ties between anchors go to the leftmost; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_arrow, drop_stage, release, slices, stage

LENGTH, K = 200, 40
#: Distinct pieces of one anchor that are ordered in one place; more are counted window by window.
GROUP = 4096
#: Pieces ordered at once (of whole groups), and rows that a kernel turns into Python objects at once.
CHUNK, SLICE = 8_000, 512
SEGMENT = 1 << 25
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for k, b in enumerate((_BASE, inverse)):
                x = np.full(n, b, dtype=np.uint64)
                x[0] = 1
                _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k bytes, by a polynomial modulo 2^64 and a mixing step."""
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_TABLE[data] * up[: len(data)])])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(text: bytes, length: int = LENGTH, k: int = K) -> list[tuple[int, int, int, int]]:
    """(hash, position, first start, last start) of every anchor: the windows with these starts have it."""
    out = []
    for base in range(0, max(1, len(text) - length + 1), SEGMENT):
        data = np.frombuffer(text[base : base + SEGMENT + length - 1], dtype=np.uint8)
        if len(data) < length:
            continue
        h = _gram_hashes(data, k)
        places = np.arange(len(h), dtype=np.uint64)
        least = _sliding_min((h >> np.uint64(26) << np.uint64(26)) | places, length - k + 1)
        at = (least & np.uint64((1 << 26) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        out += zip(h[at[first]].view(np.int64).tolist(), (at[first] + base).tolist(), (first + base).tolist(), (last + base).tolist(), strict=True)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, SLICE):
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([zlib.compress(t, 1) for t in batch.column(2).to_pylist()], pa.binary())], names=["row", "doc_id", "packed"])


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = zlib.decompress(packed)
                found = anchors(text, length, k)
                if found:
                    pieces = [xxhash.xxh3_64_intdigest(text[lo : hi + length], seed=at - lo) for _, at, lo, hi in found]
                    h, at, lo, hi = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(h, pa.int64()), pa.array(np.array(pieces, dtype=np.uint64).view(np.int64)), pa.array([row] * len(h), pa.int64()), pa.array(at, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["hash", "piece", "row", "at", "lo", "hi"])

    return run


def _piece_rows(length: int):
    """Kernel: the bytes of the asked pieces of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = zlib.decompress(packed)
                h, n, at, lo, hi = zip(*((a["hash"], a["n"], a["at"], a["lo"], a["hi"]) for a in asked), strict=True)
                data = [text[b : c + length] for b, c in zip(lo, hi, strict=True)]
                yield pa.record_batch([pa.array(h, pa.int64()), pa.array([row] * len(h), pa.int64()), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(data, pa.binary())], names=["hash", "row", "n", "at", "lo", "hi", "data"])

    return run


def repeated_starts(groups: np.ndarray, data: list[bytes], offset: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """Which windows of aligned pieces another piece of the same group has too.

    ``groups`` is sorted; ``offset[s]`` is the anchor's place in piece s.  Returns a matrix
    of pieces by columns; column c holds the window that starts c bytes after the earliest
    possible start (``length - k`` before the anchor).
    """
    m, width, reach = len(data), 2 * length - k, length - k
    # A piece's symbols at its columns; -1 where it has none.
    symbols = np.full((width, m), -1, dtype=np.int16)
    for s, (d, start) in enumerate(zip(data, (reach - offset).tolist(), strict=True)):
        symbols[start : start + len(d), s] = np.frombuffer(d, dtype=np.uint8)
    _, number, count = np.unique(groups, return_inverse=True, return_counts=True)
    levels = max(0, int(count.max() - 1).bit_length())
    order = np.arange(m)  # pieces by group, then by suffix from the present column
    common = np.zeros(m, dtype=np.int32)  # common prefix with the piece before in the order
    out = np.zeros((m, reach + 1), dtype=bool)
    base = number.astype(np.int64) * 512
    for column in range(width - 1, -1, -1):
        symbol = symbols[column][order]
        key = base[order] + symbol + 1
        turn = np.argsort(key, kind="stable")
        sorted_key = key[turn]
        # Least common prefix between consecutive pieces of the same key, over their places before.
        lo, hi = turn[:-1] + 1, turn[1:]
        same = (sorted_key[1:] == sorted_key[:-1]) & (symbol[turn][1:] >= 0)
        least = np.zeros(m - 1, dtype=np.int32)
        if same.any():
            a, b = lo[same], hi[same]
            span = b - a + 1
            level = np.zeros(len(span), dtype=np.int64)
            level[span > 1] = np.floor(np.log2(span[span > 1])).astype(np.int64)
            value, table = np.empty(len(span), dtype=np.int32), common
            for j in range(levels + 1):
                here = level == j
                if here.any():
                    value[here] = np.minimum(table[a[here]], table[b[here] - (1 << j) + 1])
                if j < levels:
                    table = np.concatenate([np.minimum(table[: -(1 << j)], table[1 << j :]), table[-(1 << j) :]]) if m > (1 << j) else table
            least[same] = value + 1
        order = order[turn]
        common = np.concatenate([[0], least]).astype(np.int32)
        if column <= reach:
            full = common >= length
            twice = full | np.concatenate([full[1:], [False]])
            out[order, column] = twice
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _order_pieces(length: int, k: int):
    """Kernel over a partition sorted by anchor hash: repeated starts of the pieces that occur once."""

    def flush(held: list[dict]) -> pa.RecordBatch:
        rows, starts, ends = [], [], []
        if len(held) > 1:
            groups = np.array([x["hash"] for x in held])
            offset = np.array([x["at"] - x["lo"] for x in held])
            found = repeated_starts(groups, [x["data"] for x in held], offset, length, k)
            for s, x in enumerate(held):
                if x["n"] == 1:
                    for a, b in _runs(found[s]):
                        rows.append(x["row"])
                        starts.append(x["at"] - (length - k) + a)
                        ends.append(x["at"] - (length - k) + b)
        return pa.record_batch([pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["row", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in slices(batches, SLICE):
            for x in batch.to_pylist():
                if len(held) >= CHUNK and held[-1]["hash"] != x["hash"]:
                    yield flush(held)
                    held = []
                held.append(x)
        yield flush(held)

    return run


def _window_rows(length: int):
    """Kernel: each window of a piece with its hash and its place against the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            for x in batch.to_pylist():
                starts = range(x["lo"], x["hi"] + 1)
                h = np.array([xxhash.xxh3_64_intdigest(x["data"][s - x["lo"] : s - x["lo"] + length], seed=x["at"] - s) for s in starts], dtype=np.uint64).view(np.int64)
                n = len(h)
                yield pa.record_batch([pa.array([x["hash"]] * n, pa.int64()), pa.array(h), pa.array([x["row"]] * n, pa.int64()), pa.array([x["n"]] * n, pa.int64()), pa.array(starts, pa.int64())], names=["hash", "window", "row", "n", "start"])

    return run


def _cut(length: int):
    """Kernel: what is left of each text without its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            out = []
            for doc, packed, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = zlib.decompress(packed)
                merged: list[list[int]] = []
                for s in sorted((s["lo"], s["hi"] + length) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out.append((doc, len(text), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """(row, lo, hi): starts of repeated windows, of texts (row, doc_id, packed)."""
    found = stage(texts.select("row", "packed").mapInArrow(_anchor_rows(length, k), "hash long, piece long, row long, at long, lo long, hi long"), "repeat-anchors")
    twice = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    live = stage(found.join(twice, "hash"), "repeat-live")
    drop_stage(found)
    release(live.sparkSession)
    pieces = stage(live.groupBy("hash", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "lo", "hi")).alias("first")), "repeat-pieces")
    whole = live.join(pieces.where("n > 1").select("hash", "piece"), ["hash", "piece"]).select("row", "lo", "hi")
    sizes = pieces.groupBy("hash").agg(F.count(F.lit(1)).alias("distinct_pieces")).where("distinct_pieces > 1")
    asked = pieces.join(sizes, "hash").select("hash", "n", "distinct_pieces", "first.*")
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct("hash", "n", "at", "lo", "hi")).alias("asked"))
    bodies = texts.select("row", "packed").join(by_row, "row").mapInArrow(_piece_rows(length), "hash long, row long, n long, at long, lo long, hi long, data binary")
    bodies = stage(bodies, "repeat-bodies")
    release(live.sparkSession)
    large = sizes.where(F.col("distinct_pieces") > group).select("hash")
    few = bodies.join(large, "hash", "left_anti")
    ordered = few.repartition("hash").sortWithinPartitions("hash").mapInArrow(_order_pieces(length, k), "row long, lo long, hi long")
    windows = stage(bodies.join(large, "hash", "left_semi").mapInArrow(_window_rows(length), "hash long, window long, row long, n long, start long"), "repeat-windows")
    shared = windows.groupBy("hash", "window").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("hash", "window")
    counted = windows.where("n = 1").join(shared, ["hash", "window"]).select("row", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return stage(whole.unionByName(ordered).unionByName(counted), "repeat-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row of ``docs``."""
    rows = binary_arrow(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "row", "doc_id", "text")
    texts = stage(rows.mapInArrow(_packed, "row long, doc_id long, packed binary"), "repeat-texts")
    spans = repeated_spans(texts, length, k, group).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    release(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return texts.join(spans, "row", "left").select("doc_id", "packed", "spans").mapInArrow(_cut(length), schema)
