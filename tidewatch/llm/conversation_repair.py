"""Conversation structure repair: an error-correcting Earley parse of role sequences.

A repaired conversation has the role initials ``(s?(ua)+)?``.  The grammar is left-linear,
over B (nothing kept yet), S (system kept), U (user kept, answer due), A (pairs complete):

    S -> B s      U -> B u | S u | A u      A -> U a      conversation -> B | A

and its error productions let a terminal be a row of that role (Keep, 0), a row of another
role (Rerole, user and assistant only, 3), or nothing (Insert an empty user or assistant, 3),
and let X -> X row leave a row out (Delete, 4).  Blank rows and duplicates must go; a
truncated row that stays adds 3.  Being left-linear, every item of the chart starts at the
first row, so a set has one item for each head, and an item retains its least (cost, audit):
of equally cheap audits, the letters D, I, K, R in order, the ASCII-least.  Audits are not
carried along: two items of one set with equal cost hold as many rows, so neither audit is a
prefix of the other, and the rank of an item among those of its set, with the letters since,
orders them exactly.

Long conversations are cut into stretches, whatever task they lie in.  A stretch is parsed
from each head that may precede it, which gives (cost, rank) from head to head; a pass over
these small tables alone composes them, as a chart over stretches, and says with which heads
every stretch begins and ends; each stretch then derives its letters and repaired rows on its
own.  Only the hash of a repaired conversation is taken serially, over a sorted stream.

Order: by turn, nulls first, then role and text.  Nulls of role and text count as one space.
Identical rows are counted before they are shuffled.

Defined results: every conversation of the input gets a row, a null id too; one without rows
has zeros, an empty audit and the hash of the empty string; texts are read whole, however
long; repeated rows are duplicates; roles are told by their first code point, rows of no
known initial can be reroled or deleted; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

BLANKS = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: head, left neighbour, terminal; U and A also follow one another without end.
PRODUCTIONS = (("S", "B", "s"), ("U", "B", "u"), ("U", "S", "u"), ("U", "A", "u"), ("A", "U", "a"))
HEADS, FINAL = "BSUA", "BA"
NAMES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, UNENDED = 4, 3, 3, 3
LEGAL = {"su", "ua", "au"}
#: Rows and code points of text that a stretch holds at most (one row may be longer).
ROWS, CHARS = 4096, 1 << 20

#: An item: cost, rank of the audit up to the last row, letters since, head at the last row.
Item = tuple[int, int, str, str]


# ---- chart ----------------------------------------------------------------------------------------------------------


def inserted(items: dict[str, Item]) -> dict[str, Item]:
    """The set with all that insertions complete."""
    out, agenda = dict(items), list(items)
    while agenda:
        left = agenda.pop()
        cost, rank, letters, base = out[left]
        for head, before, terminal in PRODUCTIONS:
            if before == left and terminal in NAMES:
                item = (cost + INSERT, rank, letters + "I", base)
                if head not in out or item < out[head]:
                    out[head] = item
                    agenda.append(head)
    return out


def scanned(items: dict[str, Item], role: str, fault: int) -> dict[str, Item]:
    """The next set: a row of initial ``role`` is kept, reroled or deleted."""
    out: dict[str, Item] = {}

    def complete(head: str, left: str, cost: int, letter: str) -> None:
        before = items[left]
        item = (before[0] + cost, before[1], before[2] + letter, before[3])
        if head not in out or item < out[head]:
            out[head] = item

    for left in items:
        complete(left, left, DELETE, "D")
        if fault not in (BLANK, DUPLICATE):
            more = UNENDED if fault == TRUNCATED else 0
            for head, before, terminal in PRODUCTIONS:
                if before == left and terminal == role:
                    complete(head, left, more, "K")
                elif before == left and terminal in NAMES:
                    complete(head, left, more + REROLE, "R")
    return out


def ranked(items: dict[str, Item]) -> dict[str, Item]:
    """Items at a row: the rank stands for the whole audit."""
    order = {key: k for k, key in enumerate(sorted({i[1:3] for i in items.values()}))}
    return {head: (i[0], order[i[1:3]], "", head) for head, i in items.items()}


def chart(roles: str, faults: bytes, entry: str) -> tuple[dict[str, Item], list[dict[str, tuple[str, str]]]]:
    """The last set at a row, and of each row the head before it and the letters that lead to a head."""
    items, back = {entry: (0, 0, "", entry)}, []
    for role, fault in zip(roles, faults, strict=True):
        found = scanned(inserted(items), role, fault)
        back.append({head: (i[3], i[2]) for head, i in found.items()})
        items = ranked(found)
    return items, back


def ended(items: dict[str, Item]) -> Item:
    """The cheapest complete item: cost, rank, letters after the last row, head at the last row."""
    closed = inserted(items)
    return min(closed[h] for h in FINAL if h in closed)


def letters_of(back: list[dict[str, tuple[str, str]]], exit_head: str) -> list[str]:
    """The letters of each row, insertions before it included, on the way to ``exit_head``."""
    out = []
    for step in reversed(back):
        exit_head, letters = step[exit_head]
        out.append(letters)
    return out[::-1]


def derived(entry: str, letters: Iterable[str], roles: str, names: list[str], texts: list[str]) -> list[str]:
    """The repaired ``role:text`` rows that audit letters (one string a row, one more at the end of a conversation) stand for."""
    out, head = [], entry
    after = {(before, terminal): made for made, before, terminal in PRODUCTIONS}
    for k, edits in enumerate(letters):
        for letter in edits:
            if letter == "D":
                continue
            due = "a" if head == "U" else "u"
            terminal = roles[k] if letter == "K" else due
            head = after[head, terminal]
            out.append(f"{NAMES[due]}:" if letter == "I" else f"{names[k] if letter == 'K' else NAMES[due]}:{texts[k]}")
    return out


# ---- stretches ------------------------------------------------------------------------------------------------------

_SUMS = ("n_rows", "blank", "duplicate", "truncated", "illegal")
_STRETCH = "conv_id long, part int, no int, roles string, faults binary, names array<string>, texts array<string>, first string, last string, ways array<struct<entry:string,exit:string,cost:long,rank:int>>, " + ", ".join(f"{c} long" for c in _SUMS)
_WAYS = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("rank", pa.int32())]))


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _cut(rows: int, chars: int) -> Callable:
    schema = [("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("roles", pa.string()), ("faults", pa.binary()), ("names", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("ways", _WAYS), *[(c, pa.int64()) for c in _SUMS]]

    def stretch(conv_id: int | None, no: int, alone: bool, held: list[tuple[str, str, int]]) -> tuple:
        roles = "".join(name[:1] or " " for name, _, _ in held)
        faults = bytes(f for _, _, f in held)
        ways = []
        for entry in "B" if alone else HEADS:  # a conversation that begins here begins with B
            items, _ = chart(roles, faults, entry)
            ways += [{"entry": entry, "exit": head, "cost": i[0], "rank": i[1]} for head, i in items.items()]
        illegal = sum(roles[k : k + 2] not in LEGAL for k in range(len(roles) - 1))
        part = TaskContext.get().partitionId()
        return (conv_id, part, no, roles, faults, [x[0] for x in held], [x[1] for x in held], roles[0], roles[-1], ways, len(held), *[faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)], illegal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kernel over rows sorted within the task: cuts each conversation's rows there into stretches."""
        held, now, no, size, begun = [], None, 0, 0, False
        seen_other = False  # another conversation ended in this task, so the one at hand begins in it
        for batch in batches:
            for conv_id, name, text, fault, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv_id != now:
                    yield _table([stretch(now, no, seen_other and no == 0, held)], schema)
                    held, no, size, seen_other = [], 0, 0, True
                now, begun = conv_id, True
                for k in range(times):
                    if len(held) >= rows or (held and size + len(text) > chars):
                        yield _table([stretch(now, no, seen_other and no == 0, held)], schema)
                        held, no, size = [], no + 1, 0
                    held.append((name, text, fault if k == 0 or fault == BLANK else DUPLICATE))
                    size += len(text)
        if held:
            yield _table([stretch(now, no, seen_other and no == 0, held)], schema)

    return run


_PATH = [("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int32()), ("entry", pa.string()), ("exit", pa.string()), ("tail", pa.string()), ("cost", pa.int64()), *[(c, pa.int64()) for c in _SUMS[1:]]]


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over stretches sorted by conversation: the heads with which each stretch begins and ends.  The last one has the sums and the tail."""

    def conversation(places: list[tuple], back: list[dict[str, str]], items: dict[str, Item], sums: list[int]) -> list[tuple]:
        cost, _, tail, head = ended(items)
        out = []
        for place, step in zip(reversed(places), reversed(back), strict=True):
            out.append((*place, step[head], head, *(("", None) if out else (tail, cost)), *([None] * 4 if out else sums)))
            head = step[head]
        return out

    now, places, back, items, sums, last = None, [], [], {}, [0] * 4, ""
    for batch in batches:
        out = []
        for conv_id, part, no, first, end, ways, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not places or conv_id != now:
                if places:
                    out += conversation(places, back, items, sums)
                now, places, back, items, sums, last = conv_id, [], [], {"B": (0, 0, "", "B")}, [0] * 4, ""
            found: dict[str, tuple] = {}
            for w in ways:
                if w["entry"] in items:
                    cost, rank, _, _ = items[w["entry"]]
                    way = (cost + w["cost"], rank, w["rank"], w["entry"])
                    if w["exit"] not in found or way < found[w["exit"]]:
                        found[w["exit"]] = way
            order = {key: k for k, key in enumerate(sorted({f[1:3] for f in found.values()}))}
            items = {head: (f[0], order[f[1:3]], "", head) for head, f in found.items()}
            back.append({head: f[3] for head, f in found.items()})
            places.append((conv_id, part, no))
            sums = [a + b for a, b in zip(sums, own, strict=True)]
            sums[3] += bool(last) and last + first not in LEGAL
            last = end
        yield _table(out, _PATH)
    if places:
        yield _table(conversation(places, back, items, sums), _PATH)


_PIECE = [("audit", pa.string()), ("repaired", pa.string())]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: the letters and repaired rows of each stretch; the other columns pass through."""
    for batch in batches:
        own = [batch.column(c).to_pylist() for c in ("roles", "faults", "names", "texts", "entry", "exit", "tail")]
        out = []
        for roles, faults, names, texts, entry, end, tail in zip(*own, strict=True):
            letters = letters_of(chart(roles, faults, entry)[1], end)
            lines = derived(entry, [*letters, tail], roles, names, texts)
            out.append(("".join(letters) + tail, "\n".join(lines) if lines else None))
        kept = [n for n, _ in _PATH if n not in ("entry", "exit", "tail")]
        made = _table(out, _PIECE)
        yield pa.record_batch([*[batch.column(c) for c in kept], *made.columns], names=[*kept, *made.schema.names])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over pieces sorted by conversation: joins audits, hashes the repaired rows as they pass."""
    schema = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
    now, begun, audit, digest, some, sums = None, False, [], hashlib.sha256(), False, []
    for batch in batches:
        out = []
        for conv_id, cost, blank, duplicate, truncated, illegal, piece, repaired in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and conv_id != now:
                out.append((now, *sums, "".join(audit), digest.hexdigest()))
                audit, digest, some = [], hashlib.sha256(), False
            now, begun = conv_id, True
            audit.append(piece)
            if repaired is not None:
                digest.update(b"\n" * some + repaired.encode())
                some = True
            sums = [blank, duplicate, truncated, illegal, cost]
        yield _table(out, schema)
    if begun:
        yield _table([(now, *sums, "".join(audit), digest.hexdigest())], schema)


# ---- tables ---------------------------------------------------------------------------------------------------------


def _text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """The rows with faults laid in by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 takes the sentence ends, 3 repeats, 4 makes a user's."""
    case = F.crc32(F.encode(F.concat(_text_of(F.col("conv_id")), F.lit(":"), _text_of(F.col("turn"))), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", _text_of(F.col("role")).alias("role"), _text_of(F.col("text")).alias("text"), case.alias("case")).where("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("case") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _faults(turns: DataFrame) -> DataFrame:
    """Distinct rows with the fault of their first copy and how often they occur."""
    rows = turns.select("conv_id", "turn", _text_of(F.col("role")).alias("role"), _text_of(F.col("text")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times")).withColumn("digest", F.sha2("text", 256))
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(at).alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    shown = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(shown == "", BLANK).when(at > F.col("first"), DUPLICATE).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "times")


def repair(turns: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of (conv_id, turn, role, text)."""
    key = ["conv_id", "turn", "role", "text"]
    found = _faults(turns)
    laid = found.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", "role", "text", "fault", "times")
    stretches = stage(laid.mapInArrow(_cut(rows, chars), _STRETCH), "repair-stretches")
    place = ["conv_id", "part", "no"]
    small = stretches.select(*place, "first", "last", "ways", *_SUMS[1:]).repartition("conv_id").sortWithinPartitions(*place)
    path = small.mapInArrow(_composed, "conv_id long, part int, no int, entry string, exit string, tail string, cost long, " + ", ".join(f"{c} long" for c in _SUMS[1:]))
    path = path.withColumnRenamed("conv_id", "c")
    own = stretches.select(*place, "roles", "faults", "names", "texts").join(path, F.col("conv_id").eqNullSafe(F.col("c")) & (stretches["part"] == path["part"]) & (stretches["no"] == path["no"])).drop("c", path["part"], path["no"])
    sums = "cost long, " + ", ".join(f"{c} long" for c in _SUMS[1:])
    pieces = own.mapInArrow(_repaired, f"conv_id long, part int, no int, {sums}, audit string, repaired string")
    pieces = pieces.repartition("conv_id").sortWithinPartitions(*place).select("conv_id", "cost", *_SUMS[1:], "audit", "repaired")
    whole = pieces.mapInArrow(_hashed, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    missing = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = turns.groupBy(F.col("conv_id").alias("g")).agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))
    return whole.join(gaps, F.col("conv_id").eqNullSafe(F.col("g"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """:func:`repair` of :func:`damage`, with a row for every conversation, those without rows left included."""
    broken = stage(damage(turns), "repair-damaged")
    fixed = repair(broken).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
