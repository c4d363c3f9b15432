"""Spelling variants: words one code point apart, found in forward and backward minimal automata.

A word of L code points that differs from another by one error (a code point inserted,
deleted or replaced) agrees with it either on its first L // 2 code points or on its last
L - L // 2.  Words are therefore dealt by those halves, forward and reversed, each under the
halves that a word one shorter, as long or one longer asks with.  A half's words form one
group; a minimal acyclic automaton over what follows the half numbers them (the number of a
word is its rank), and each asking word, its half matched by the deal, is completed with one
error.  Numbers dedupe what one automaton finds in several ways; a pair found backward that
agrees on the first half as well is left to the forward group, so every pair counts once.

A group of more than ``group`` words is dealt once more: what follows the half is cut in two
and one of the two parts agrees as well, so its words go by (half, next part) and by
(half, last part), and no group's size can grow with the table beyond the alphabet's few
middle code points.  No word is dropped.

A word's form is its near word with the largest count, if that is at least ``ratio`` times
its own; ties take the smallest word in code-point order.  Its root follows forms to the
last by pointer doubling; counts grow along forms, so chains are short and free of cycles.

Defined results: null or empty texts hold no words; a null doc_id counts as empty where
typing errors are laid in; texts are read whole; repeated rows count again; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_arrow, drop_stage, small, stage

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Every so many-th (document, word) gets a typing error laid in.
TYPO_EVERY = 31
#: A group of more words is dealt once more.
GROUP = 20_000
#: Words that a counting task remembers before it hands its counts on.
MEMO_WORDS = 400_000
MAX_ROUNDS = 10


# ---- counting -------------------------------------------------------------------------------------------------------


def with_typo(doc_id: int | None, word: str, every: int = TYPO_EVERY) -> str:
    """The word as document ``doc_id`` spells it: one code point less where the checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _counted(typo_every: int | None, min_length: int) -> Callable:
    # A run shorter than min_length stays shorter, whatever is deleted.
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(runs(text.lower().decode())).items():  # lower() of bytes: A-Z alone
                    if typo_every:
                        word = with_typo(doc_id, word, typo_every)
                        if len(word) < min_length:
                            continue
                    total[word] += n
            if len(total) > MEMO_WORDS:
                yield pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                total = Counter()
        yield pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return run


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """(word, n) of the letter runs of at least ``min_length`` code points seen ``min_count`` times or more; ``typo_every`` lays typing errors in first."""
    parts = binary_arrow(docs, "doc_id", "text").mapInArrow(_counted(typo_every, min_length), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- automata -------------------------------------------------------------------------------------------------------


class Automaton:
    """Minimal acyclic automaton of sorted distinct words; a word's number is its rank among them.

    A node is (final, {code point: (node, words before it)}, words that it accepts).
    """

    def __init__(self, words: list[str]):
        self.nodes: list[tuple[bool, dict[str, tuple[int, int]], int]] = []
        known: dict[tuple, int] = {}
        open_nodes: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]
        before = ""

        def close(depth: int) -> None:
            """Nodes below ``depth`` of the word before take no more edges: equal ones become one."""
            while len(open_nodes) > depth:
                (final,), edges = open_nodes.pop()
                shape = (final, *edges)
                k = known.get(shape)
                if k is None:
                    k = known[shape] = len(self.nodes)
                    accepted, out = int(final), {}
                    for c, child in edges:
                        out[c] = (child, accepted)
                        accepted += self.nodes[child][2]
                    self.nodes.append((final, out, accepted))
                if open_nodes:
                    open_nodes[-1][1].append((before[len(open_nodes) - 1], k))
                else:
                    self.root = k

        for word in words:
            shared = 0
            for a, b in zip(before, word):  # noqa: B905  up to the shorter one
                if a != b:
                    break
                shared += 1
            close(shared + 1)
            open_nodes += [([False], []) for _ in range(len(word) - shared)]
            open_nodes[-1][0][0] = True
            before = word
        close(0)

    def _rest(self, node: int, number: int, word: str, at: int) -> int:
        """The number of the word that follows word[at:] from ``node``, -1 if there is none."""
        nodes = self.nodes
        for c in word[at:]:
            step = nodes[node][1].get(c)
            if step is None:
                return -1
            node, number = step[0], number + step[1]
        return number if nodes[node][0] else -1

    def one_error(self, word: str) -> set[int]:
        """Numbers of the words that differ from ``word`` by exactly one code point inserted, deleted or replaced."""
        nodes, rest, found = self.nodes, self._rest, set()
        node, number, last = self.root, 0, len(word)
        for i in range(last + 1):
            out = nodes[node][1]
            c = word[i] if i < last else None
            if c is not None:
                found.add(rest(node, number, word, i + 1))
            for other, (child, before) in out.items():
                if other != c:  # the same code point once more is found one place on
                    found.add(rest(child, number + before, word, i))
                    if c is not None:
                        found.add(rest(child, number + before, word, i + 1))
            step = out.get(c)
            if step is None:
                break
            node, number = step[0], number + step[1]
        found.discard(-1)
        return found


# ---- groups ---------------------------------------------------------------------------------------------------------

#: Code points that a word of L asks with, forward and backward.
_HALF = {"f": lambda n: F.floor(n / 2).cast("int"), "b": lambda n: (n - F.floor(n / 2)).cast("int")}
_GROUPS = "kind string, key string, word string, n long, asks boolean"


def _dealt(words: DataFrame, min_length: int) -> DataFrame:
    """Every word under the halves of the words that can be near it: kind f or b (reversed), key, word, n, asks."""
    size = F.char_length("word")
    out = None
    for kind, half in _HALF.items():
        asked = F.array_distinct(F.transform(F.filter(F.array(size - 1, size, size + 1), lambda n: n >= min_length), half))
        spelt = F.col("word") if kind == "f" else F.reverse("word")
        rows = words.select(spelt.alias("word"), "n", half(size).alias("own"), F.explode(asked).alias("k"))
        rows = rows.select(F.lit(kind).alias("kind"), F.substring(F.col("word"), F.lit(1), F.col("k")).alias("key"), "word", "n", (F.col("k") == F.col("own")).alias("asks"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _dealt_again(rows: DataFrame, min_length: int) -> DataFrame:
    """Rows of large groups by (half, next part) as kind f1, b1 and by (half, last part) as f2, b2."""
    size, half = F.char_length("word"), F.char_length("key")
    out = None
    for kind in _HALF:
        lengths = F.filter(F.array(size - 1, size, size + 1), lambda n: (n >= min_length) & (_HALF[kind](n) == half))  # noqa: B023  used at once
        part = lambda n: F.floor((n - half) / 2).cast("int")
        keys = F.array_distinct(
            F.flatten(
                F.transform(
                    lengths,
                    lambda n: F.array(
                        F.struct(F.lit(f"{kind}1").alias("kind"), F.substring(F.col("word"), F.lit(1), half + part(n)).alias("key"), (n == size).alias("asks")),  # noqa: B023
                        F.struct(F.lit(f"{kind}2").alias("kind"), F.concat("key", F.lit("\0"), F.right(F.col("word"), n - half - part(n))).alias("key"), (n == size).alias("asks")),  # noqa: B023
                    ),
                )
            )
        )
        one = rows.where(F.col("kind") == kind).select("word", "n", F.col("asks").alias("may"), F.explode(keys).alias("g"))
        one = one.groupBy("g.kind", "g.key", "word", "n").agg(F.max(F.col("may") & F.col("g.asks")).alias("asks"))
        out = one if out is None else out.unionByName(one)
    return out


def _halves(kind: str, size: int) -> int:
    return size // 2 if kind[0] == "f" else size - size // 2


def _elsewhere(kind: str, word: str, other: str) -> bool:
    """Whether the pair, found in a group of this kind, belongs to a group that comes before."""
    if kind[0] == "b" and word[len(word) - len(word) // 2 :] == other[len(other) - len(word) // 2 :]:
        return True  # words are reversed here: the forward half agrees
    if kind[1:] == "2":
        h = _halves(kind, len(word))
        a = h + (len(word) - h) // 2
        return word[:a] == other[:a]
    return False


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over rows sorted by (kind, key, word): each asking word's near words in its group, counted, with the best."""
    out: list[tuple] = []

    def group(kind: str, key: str, words: list[str], ns: list[int], asks: list[bool]) -> None:
        if len(words) < 2 or not any(asks):
            return
        shared = key.split("\0")[0]
        k = len(shared)
        automaton = Automaton([w[k:] for w in words])
        for word, n, ask in zip(words, ns, asks, strict=True):
            if not ask:
                continue
            near = [m for m in automaton.one_error(word[k:]) if not _elsewhere(kind, word, words[m])]
            if near:
                turn = 1 if kind[0] == "f" else -1
                best = min((-ns[m], words[m][::turn]) for m in near)
                out.append((word[::turn], n, len(near), -best[0], best[1]))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n", "n_near", "best_n", "best"])

    now: tuple[str, str] | None = None
    held: tuple[list[str], list[int], list[bool]] = ([], [], [])
    for batch in batches:
        for kind, key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, key) != now:
                if now:
                    group(*now, *held)
                now, held = (kind, key), ([], [], [])
            for column, v in zip(held, row, strict=True):
                column.append(v)
        if len(out) > 10_000:
            yield batch_of()
    if now:
        group(*now, *held)
    yield batch_of()


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, group: int = GROUP) -> DataFrame:
    """(word, n, n_near, best_n, best) of (word, n), whose words are distinct and have ``min_length`` code points or more."""
    rows = _dealt(words, min_length)
    large = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group).select("kind", "key")
    large = stage(large, "spelling-large")
    if large.limit(1).count():
        held = small(large)
        rows = rows.join(held, ["kind", "key"], "left_anti").unionByName(_dealt_again(rows.join(held, ["kind", "key"], "left_semi"), min_length))
    rows = rows.select("kind", "key", "word", "n", "asks").repartition("kind", "key").sortWithinPartitions("kind", "key", "word")
    found = rows.mapInArrow(_searched, "word string, n long, n_near long, best_n long, best string")
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    near = alone.unionByName(found).groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
    return near.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.form").alias("best"))


def roots_of(links: DataFrame) -> DataFrame:
    """(word, root) of (word, root): every root followed to the last, twice as far each round."""
    now = stage(links, "spelling-roots")
    for _ in range(MAX_ROUNDS):
        on = small(now.select(F.col("word").alias("root"), F.col("root").alias("after")))
        further = stage(now.join(on, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "spelling-roots")
        drop_stage(now)
        now = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return now
    raise RuntimeError("forms go in a circle")


def group_variants(words: DataFrame, min_length: int = MIN_LENGTH, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of (word, n)."""
    words = stage(words, "spelling-words")
    found = near_words(words, min_length, group)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = stage(found.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    drop_stage(words)
    roots = roots_of(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(small(roots), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
