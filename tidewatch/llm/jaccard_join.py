"""Exact Jaccard self-join on word n-grams by rare-first prefix filtering.

1. Each text becomes a set of 64-bit shingle hashes.  Equal sets form a class and take part
   once (class key: a 128-bit digest of the set; a class is named by its first row).
2. All sets share one order of shingles: a hashed share of them comes first, by corpus
   frequency (rare first), then the rest by hash.  The frequencies are counted over all
   documents by hash ranges: each task ships its shingles of a range as one sorted, delta
   coded array, and the range's task gives back those that two rows hold.  Two sets can only
   reach the limit if they share a shingle among the first ``n - ceil(t n) + 1`` of each;
   shingles of a single class can't be shared, so a set with enough of them has no partner.
3. Classes are joined on prefix shingle and size bucket (sizes within the limit lie in the
   same or neighbouring buckets): each shingle and bucket links its classes to the least of
   them, never all pairs, and what is linked meets in one candidate cluster.
4. Within a cluster, sets meet in blocks: by size bucket and a hashed block of at most
   ``BLOCK`` sets.  In a pair of blocks the sets are joined on their prefix shingles; the
   length filter, the positional filter (shingles left after the shared one) and the suffix
   filter (shared shingles possible in each of 16 hash ranges) leave candidates, and each is
   verified once by the whole intersection, unless its sets are linked already; only a
   spanning forest of the links leaves the task.
5. Links make components; classes pass theirs to all their documents.

Defined results: null text or no words gives the empty set, linked with nothing; with fewer
words than ``shingle`` the whole sequence is the one shingle; texts are taken whole, however
long; repeated rows, equal sets and rows that share a doc_id take part with their own texts;
a row with a null doc_id links like any other and has the least known id of its component,
null if there is none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_arrow, drop_stage, release, small, stage
from .components import components

BLOCK = 512
#: Class keys a task remembers so as to emit a copied set's shingles once.
SEEN = 500_000
#: Shingles that a task gathers before it ships their arrays.
FLUSH = 1_000_000
#: Hash ranges for each shuffle partition of the session.
RANGES = 4
#: Pairs of prefix places that are joined at once.
STRIP = 2_000_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word k-grams (A-Z lower-cased)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    n = len(words) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * MIX[j % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_length(n, percent: int):
    """Shingles of a set of size n of which one must be shared: n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1


def _first(s: np.ndarray, share: int) -> np.ndarray:
    """Marks the shingles that come first in the order: a hashed share, in 1/1024."""
    return (s >> np.uint64(20)) % np.uint64(1024) < np.uint64(share)


def class_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


ROWS = "row long, doc_id long, key binary, n int, held int, range int, base long, shingles binary, owners binary"
_TYPES = [("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("held", pa.int32()), ("range", pa.int32()), ("base", pa.int64()), ("shingles", pa.binary()), ("owners", pa.binary())]


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.record_batch([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)) if c in columns else pa.nulls(n, t) for c, t in _TYPES], names=[c for c, _ in _TYPES])


def cut_ranges(tokens: np.ndarray, owners: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """For each hash range: its 48-bit tokens in order, as differences, and their owners."""
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    ends = np.searchsorted(tokens, (np.arange(1, ranges + 1, dtype=np.float64) * 2.0**48 / ranges).astype(np.uint64))
    at = 0
    for k, end in enumerate(ends.tolist()):
        if end > at:
            steps = np.diff(tokens[at:end], prepend=np.uint64(0))
            kind = np.uint32 if len(steps) < 2 or steps[1:].max() < 1 << 32 else np.uint64
            first, rest = steps[:1].astype("<u8").tobytes(), steps[1:].astype(kind).tobytes()
            own = owners[at:end]
            yield k, first + bytes([np.dtype(kind).itemsize]) + rest, own.astype(np.uint16 if own.max() < 1 << 16 else np.uint32).tobytes()
        at = end


def read_range(shingles: bytes, owners: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(shingles[9:], dtype=np.uint32 if shingles[8] == 4 else np.uint64)
    tokens = np.cumsum(np.concatenate([np.frombuffer(shingles[:8], dtype="<u8"), steps.astype(np.uint64)]), dtype=np.uint64)
    return tokens, np.frombuffer(owners, dtype=np.uint16 if len(owners) == 2 * len(tokens) else np.uint32).astype(np.int64)


def _sets(k: int, percent: int, share: int, ranges: int):
    """Kernel: a row for each document (class key, sizes); once a task and class, the shingles its prefix may come from, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held_tokens, held_owners, n_held, base = [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(cut_ranges(np.concatenate(held_tokens), np.concatenate(held_owners), ranges))
            for at in range(0, len(found), 64):
                r, tokens, owners = zip(*found[at : at + 64], strict=True)
                yield _batch({"range": r, "base": [base] * len(r), "shingles": tokens, "owners": owners}, len(r))

        for batch in batches:
            rows, keys, sizes, held = batch.column(0).to_pylist(), [], [], []
            for row, text in zip(rows, batch.column(2), strict=True):
                s = shingle_set(text.as_py(), k)
                key = class_key(s) if len(s) else None
                first = _first(s, share)
                p, n_first = prefix_length(len(s), percent) if len(s) else 0, int(first.sum())
                keys.append(key)
                sizes.append(len(s))
                held.append(max(p, n_first))
                if key is None or key in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                own = s[first] if n_first >= p else np.concatenate([s[first], s[~first][: p - n_first]])
                if n_held and (n_held + len(own) > FLUSH or row - base >= 1 << 32):
                    yield from flush()
                    held_tokens, held_owners, n_held = [], [], 0
                if not n_held:
                    base = row
                held_tokens.append(own >> np.uint64(16))
                held_owners.append(np.full(len(own), row - base, dtype=np.uint32))
                n_held += len(own)
            yield _batch({"row": rows, "doc_id": batch.column(1), "key": keys, "n": sizes, "held": held}, len(rows))
        if n_held:
            yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over hash ranges in order: (row, token, f) of the tokens that at least two rows hold."""

    def found(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(tokens, kind="stable")
        tokens, rows = tokens[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.concatenate([first, [len(tokens)]]))
        f = np.repeat(count, count)
        keep = f > 1
        for at in range(0, int(keep.sum()), 65536):
            part = slice(at, at + 65536)
            yield pa.record_batch([pa.array(rows[keep][part]), pa.array(tokens[keep][part].astype(np.int64)), pa.array(f[keep][part].astype(np.int32))], names=["row", "token", "f"])

    held, now = [], None
    for batch in batches:
        for r, base, shingles, owners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != now and held:
                yield from found(held)
                held = []
            now = r
            tokens, own = read_range(shingles, owners)
            held.append((tokens, own + base))
    if held:
        yield from found(held)


def _keyed_sets(k: int):
    """Kernel: class key and whole set of the documents, as bytes; each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sets = [s for t in batch.column(0).to_pylist() if len(s := shingle_set(t, k)) and (key := class_key(s)) not in seen and (len(seen) >= SEEN or not seen.add(key))]
            yield pa.record_batch([pa.array([class_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])

    return run


def prefix_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Candidate pairs (i < j) of the sets, from the join on prefix tokens with length and positional filter, in strips.

    ``side``: 0 meets 1, 2 meets all.  The order of tokens is by frequency among these sets, rare first.
    """
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, count[token], owner))
    owner, token = owner[order], token[order]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    use = (place < prefix_length(n, percent)[owner]) & (count[token] > 1)
    owner, token, place = owner[use], token[use], place[use]
    if not len(token):
        return
    order = np.lexsort((owner, token, count[token]))  # the postings of each token, rare tokens first
    owner, token, place = owner[order], token[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    end = np.concatenate([first[1:], [len(token)]]).astype(np.int64)
    later = np.repeat(end, end - first) - np.arange(len(token)) - 1  # postings of the same token that follow each one
    upto = np.cumsum(later)
    lo = 0
    while lo < len(token):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STRIP)))
        a = np.repeat(np.arange(lo, hi), later[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[lo:hi]) - later[lo:hi], later[lo:hi])
        lo = hi
        i, j = owner[a], owner[b]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))  # least intersection
        left = 1 + np.minimum(n[i] - place[a] - 1, n[j] - place[b] - 1)
        good = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (left >= need) & ((side[i] + side[j] == 1) | (side[i] == 2) | (side[j] == 2))
        if good.any():
            yield np.unique(np.stack([i[good], j[good]], axis=1), axis=0)


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the sets of two sides, as a spanning forest; each candidate is verified once by its whole intersection."""
    n = np.array([len(s) for s in sets])
    bins = np.stack([np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=16) for s in sets])
    root, met, forest = np.arange(len(sets)), np.zeros((len(sets), len(sets)), dtype=bool), []
    for pairs in prefix_pairs(sets, side, percent):
        i, j = pairs.T
        new = ~met[i, j] & (root[i] != root[j])
        met[i, j] = True
        i, j = i[new], j[new]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        most = np.zeros(len(i), dtype=np.int64)
        for b in range(16):  # suffix filter: in each hash range at most the smaller count is shared
            most += np.minimum(bins[i, b], bins[j, b])
        for a, b, least in zip(i[most >= need].tolist(), j[most >= need].tolist(), need[most >= need].tolist(), strict=True):
            if root[a] != root[b] and len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= least:
                forest.append((a, b))
                root[root == root[b]] = root[a]
    return forest


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        names = table.column("class").to_pylist()
        table = table.take(sorted({c: k for k, c in enumerate(names)}.values()))  # a set may come from several tasks
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()]
        names, side = table.column("class").to_pylist(), np.array(table.column("side").to_pylist())
        alone = len(sets) < 2 or (side == 0).all() or (side == 1).all()
        links = [] if alone else linked_pairs(sets, side, percent)
        return pa.table([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())], names=["a", "b"])

    return run


def _prefixes(classes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(class, n, token) of the prefix tokens that other rows hold too."""
    first = F.pmod(F.shiftright("token", 4), F.lit(1024)) < share_of(percent)
    of_row = shared.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((~first).alias("late"), "f", "token"))).alias("own"))
    mine = classes.join(of_row, classes["class"] == of_row["row"]).select("class", "n", "held", "own")
    # Tokens of one row alone come first; what is left of the prefix are the rarest shared ones.
    p = F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1
    left = p - (F.col("held") - F.size("own"))
    return mine.withColumn("left", left).where("left > 0").select("class", "n", F.explode(F.expr("slice(own, 1, int(left))")).alias("t")).select("class", "n", F.col("t.token").alias("token"))


def _clusters(prefix: DataFrame, percent: int) -> DataFrame:
    """(class, n, cluster) of the classes that share a prefix shingle with another class of like size."""
    bucket = size_bucket(F.col("n"), percent)
    keyed = prefix.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))  # sizes in neighbouring buckets share one of them
    least = keyed.groupBy("token", "bucket").agg(F.min("class").alias("b"), F.max("class").alias("hi")).where("b < hi").select("token", "bucket", "b")
    links = stage(keyed.join(least, ["token", "bucket"]).where("class <> b").select(F.col("class").alias("a"), "b").distinct(), "join-candidates")
    found = components(links).withColumnsRenamed({"node": "class", "component": "cluster"})
    drop_stage(links)
    return prefix.select("class", "n").distinct().join(found, "class")


def size_bucket(n, percent: int):
    """Number of the size's bucket: sizes that can reach the limit lie in the same or neighbouring buckets."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) - 1e-9).cast("int")


def share_of(percent: int) -> int:
    """Share (in 1/1024) of the shingles whose frequency orders the prefixes: 1.7 times what prefixes take."""
    return min(1024, round(1024 * 1.7 * (100 - percent) / 100))


def _links(docs: DataFrame, classes: DataFrame, shared: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes: a spanning forest within every pair of blocks."""
    prefix = stage(_prefixes(classes, shared, percent), "join-prefix")
    drop_stage(shared)
    release(docs.sparkSession)
    grouped = stage(_clusters(prefix, percent), "join-clusters")
    drop_stage(prefix)
    release(docs.sparkSession)
    sized = grouped.withColumn("bucket", size_bucket(F.col("n"), percent))
    blocks = stage(sized.groupBy("cluster", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "join-blocks")
    at = lambda shift, name: blocks.select("cluster", (F.col("bucket") + shift).alias("bucket"), F.col("blocks").alias(name))
    sized = sized.join(at(0, "own"), ["cluster", "bucket"]).join(at(1, "below"), ["cluster", "bucket"], "left").join(at(-1, "above"), ["cluster", "bucket"], "left")
    block = F.pmod(F.xxhash64("class"), F.col("own")).cast("int").alias("block")
    placed = stage(sized.join(classes.select("class", "key", "first_id"), "class").select("class", "key", "first_id", "cluster", "bucket", block, "own", "below", "above"), "join-placed")
    drop_stage(grouped, blocks)
    # Texts by doc_id, then by the set they make: rows that share an id, or have none, keep apart.
    ids = small(placed.select(F.col("first_id").alias("doc_id")).distinct().withColumn("no_id", F.col("doc_id").isNull()).fillna(0, ["doc_id"]))
    asked = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text").join(ids, ["doc_id", "no_id"], "left_semi")
    sets = binary_arrow(asked, "text").mapInArrow(_keyed_sets(k), "key binary, set binary")
    # Where a set is needed: its own block (side 2: both), blocks of its bucket before and after, of the next buckets.
    meet = F.expr(
        """concat(array(struct(bucket AS b1, block AS i, bucket AS b2, block AS j, 2 AS side)),
                  transform(filter(sequence(0, own - 1), x -> x > block), x -> struct(bucket AS b1, block AS i, bucket AS b2, x AS j, 0 AS side)),
                  transform(filter(sequence(0, own - 1), x -> x < block), x -> struct(bucket AS b1, x AS i, bucket AS b2, block AS j, 1 AS side)),
                  if(above IS NULL, array(), transform(sequence(0, above - 1), x -> struct(bucket AS b1, block AS i, bucket + 1 AS b2, x AS j, 0 AS side))),
                  if(below IS NULL, array(), transform(sequence(0, below - 1), x -> struct(bucket - 1 AS b1, x AS i, bucket AS b2, block AS j, 1 AS side))))"""
    )
    tasks = sets.join(small(placed.drop("first_id")), "key").select("class", "cluster", "set", F.explode(meet).alias("m")).select("class", "cluster", "set", "m.*")
    links = stage(tasks.groupBy("cluster", "b1", "i", "b2", "j").applyInArrow(_verify(percent), "a long, b long"), "join-links")
    drop_stage(placed)
    release(docs.sparkSession)
    return links


def join_components(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = binary_arrow(docs.withColumn("row", F.monotonically_increasing_id()), "row", "doc_id", "text")
    both = stage(numbered.mapInArrow(_sets(shingle, percent, share_of(percent), ranges), ROWS), "join-sets")
    rows = stage(both.where("row IS NOT NULL").select("row", "doc_id", "key", "n", "held"), "join-rows")
    # A class is named by its first row, whose task has shipped its shingles.
    first = F.min(F.struct("row", "doc_id", "n", "held"))
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(first.alias("f"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    classes = stage(classes.select(F.col("f.row").alias("class"), "key", F.col("f.doc_id").alias("first_id"), F.col("f.n").alias("n"), F.col("f.held").alias("held"), "least", "n_rows"), "join-classes")
    blobs = both.where("range IS NOT NULL").select("range", "base", "shingles", "owners")
    shared = stage(blobs.repartition("range").sortWithinPartitions("range").mapInArrow(_shared, "row long, token long, f int"), "join-shared")
    drop_stage(both)
    release(spark)
    links = _links(docs, classes, shared, shingle, percent)
    found = components(links).withColumnsRenamed({"node": "class", "component": "root"})
    of_class = classes.select("class", "key", "least", "n_rows").join(small(found), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n_rows").alias("component_rows"))
    # Only classes with company need the join; all others answer for themselves.
    company = stage(of_class.join(least, "root").where("component_rows > 1").select("key", "component_id"), "join-company")
    drop_stage(links, classes)
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "key").join(small(company), "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (with that id repeated, all of its rows)."""
    drop = join_components(docs, shingle, percent).where("component_id <> doc_id").select("doc_id").distinct()
    drop = stage(drop, "join-drop")
    return docs.join(small(drop), "doc_id", "left_anti")
