"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: the total (``budget`` times all words) is shared by the sources' weights; a target
stops at ``most`` times its source's words and the excess is shared again by weight.  Each
source's documents fall into a fixed number of blocks by a seeded hash.  Whole passes take
every block; the last, partial pass takes blocks in a permuted order up to the target, and
the block in which the target falls is resolved by its own sub-blocks, the last of them by
the same share of every document in it (its first words).  All draws of blocks are then
dealt to output shards: a tree splits the shards in halves and a multivariate
hypergeometric draw splits the sources' exact block quotas at each node, so that each shard
gets a random, disjoint run of every source's permuted blocks; ``local_order`` shuffles
within the shard.  Everything is a function of the seed and the rows, so reruns agree.

Defined results: null text has no words and is never taken; a null source is a source of
its own, last in order; sources without words have target 0; repeated rows share a block
and are taken alike; an empty table gives no rows; other columns are left alone.
The driver holds one number for each source, and shards times sources block quotas.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, drop_stage, give_back, own_columns, small, stage, whole_text

WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2.0
BLOCKS = 4096
SHARDS = 64
SEED = 20_240


def n_words(text: Column) -> Column:
    """Number of words, without making them."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"[^{SPACE}]+", "x"), f"[{SPACE}]+", "")).cast("long")


def fill_targets(sizes: list[int], weights: list[float], budget: float = BUDGET, most: float = MOST) -> list[float]:
    """Targets by weight, each at most ``most`` times its size, what is over shared again by weight."""
    left, open_ = budget * sum(sizes), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if unit * weights[k] > most * sizes[k]}
        if not over:
            for k in open_:
                targets[k] = unit * weights[k]
            break
        for k in over:
            targets[k] = most * sizes[k]
            left -= targets[k]
        open_ -= over
    return targets


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (sources by shards): halves of the shards, hypergeometric draws."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def split(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        n_left = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(counts, n_left, method="marginals") if total else counts
        split(lo, mid, left)
        split(mid, hi, counts - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def _partial(cells: DataFrame, keys: list[str], order: list[Column], need: str) -> DataFrame:
    """Of cells (keys, cell words) how many words each gives when taken in order until ``need``."""
    before = F.sum("cell_words").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    room = F.col(need) - F.coalesce(before, F.lit(0))
    return cells.withColumn("gives", F.greatest(F.lit(0).cast("long"), F.least("cell_words", room)))


MADE = ("size", "source_size", "target", "taken", "shards", "local_order")


def _mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The caller's columns as ``_own`` with the made ones."""
    spark = docs.sparkSession
    where = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.crc32(F.encode(whole_text(), "UTF-8")))
    keyed = docs.select(own_columns(docs, keep), "source", n_words(whole_text()).alias("size"), where.alias("_h"))
    keyed = keyed.withColumns({"_block": F.pmod("_h", F.lit(blocks)).cast("int"), "_sub": F.pmod(F.shiftright("_h", 20), F.lit(blocks)).cast("int")})
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_source")
    keyed = keyed.withColumn("_source", key).drop("source")
    cells = stage(keyed.groupBy("_source", "_block", "_sub").agg(F.sum("size").alias("cell_words")), "mix-cells")
    # One row for each source reaches the driver.
    found = sorted(((r[0].none, r[0].name.encode(), r[0].name, int(r.words)) for r in cells.groupBy("_source").agg(F.sum("cell_words").alias("words")).collect()))
    sizes = [s for *_, s in found]
    targets = fill_targets(sizes, [float(weights[k % len(weights)]) for k in range(len(found))], budget, most) if found else []
    rows = []
    for (none, _, name, size), target in zip(found, targets, strict=True):
        passes = min(int(most), round(target) // size) if size else 0
        rows.append(((none, name), size, float(target), passes, round(target) - passes * size if size else 0))
    plan = spark.createDataFrame(rows, "_source struct<none:boolean,name:string>, source_size long, target double, passes int, need long")
    sources = stage(plan, "mix-plan")
    by_block = cells.groupBy("_source", "_block").agg(F.sum("cell_words").alias("cell_words")).join(sources, "_source")
    permuted = [F.xxhash64(F.lit(seed + 1), F.col("_source.name"), F.col("_block")), F.col("_block")]
    given = _partial(by_block, ["_source"], permuted, "need").withColumnRenamed("cell_words", "block_words")
    # The block in which the target falls: its sub-blocks in turn.
    cut = given.where("gives > 0 AND gives < block_words").select("_source", "_block", F.col("gives").alias("block_need"))
    inner = _partial(cells.join(cut, ["_source", "_block"]), ["_source", "_block"], [F.xxhash64(F.lit(seed + 2), "_source.name", "_sub"), F.col("_sub")], "block_need")
    inner = inner.groupBy("_source", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_sub", F.struct("gives", "cell_words")))).alias("subs"))
    # Draws: (source, pass, block); each source's draws in permuted order, cut into its shards' quotas.
    draws = given.withColumn("_pass", F.explode(F.expr("sequence(1, passes + int(gives > 0))")))
    draws = draws.where(F.col("_pass") <= F.col("passes") + (F.col("gives") > 0).cast("int"))
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed + 3), F.col("_source.name"), "_pass", "_block"), "_pass", "_block")
    draws = stage(draws.withColumn("_rank", F.row_number().over(order)).select("_source", "_block", "_pass", "_rank"), "mix-draws")
    n_draws = {(r[0].none, r[0].name): r.n for r in draws.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = split_tree(np.array([n_draws.get((none, name), 0) for none, _, name, _ in found], dtype=np.int64), shards, seed)
    ends = spark.createDataFrame([((none, name), [int(x) for x in np.cumsum(quotas[k])]) for k, (none, _, name, _) in enumerate(found)], "_source struct<none:boolean,name:string>, ends array<bigint>")
    dealt = draws.join(ends, "_source").withColumn("_shard", F.size(F.filter("ends", lambda e: e < F.col("_rank"))))
    by_draw = dealt.groupBy("_source", "_block").agg(F.array_sort(F.collect_list(F.struct("_pass", "_shard"))).alias("_draws"))
    facts = stage(given.select("_source", "_block", "source_size", "target", "passes", "gives", "block_words").join(inner, ["_source", "_block"], "left").join(by_draw, ["_source", "_block"], "left"), "mix-facts")
    drop_stage(cells, sources, draws)
    # At most a row for each block of each source, whatever the corpus: the texts stay where they are while that is few.
    out = keyed.join(small(facts), ["_source", "_block"])
    sub = F.element_at("subs", F.col("_sub"))
    share = F.floor(F.col("size") * sub["gives"] / sub["cell_words"]).cast("long")
    last = F.when(F.col("gives") == 0, 0).when(F.col("gives") == F.col("block_words"), F.col("size")).when(sub["gives"] == sub["cell_words"], F.col("size")).otherwise(F.coalesce(share, F.lit(0)))
    out = out.withColumn("taken", (F.col("passes") * F.col("size") + last).cast("long"))
    whole = F.ceil(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("int")
    shards_of = F.slice(F.transform(F.coalesce("_draws", F.array().cast("array<struct<_pass:int,_shard:int>>")), lambda d: d["_shard"]), F.lit(1), whole)
    return out.withColumns({"shards": shards_of, "local_order": F.xxhash64(F.lit(seed + 4), "_h")}).select("_own", *MADE)


def mix(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """``docs`` (or its columns named in ``keep``) with size, source_size, target, taken, shards (one for each draw of the row) and local_order."""
    return _mix(docs, keep, **options).select(*give_back(docs, keep, MADE), *MADE)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken; one taken in part is cut to its first words.  The takes lie shard by shard in local order."""
    takes = _mix(docs, **options).where("taken > 0").withColumn("_take", F.explode(F.expr("sequence(1, int(ceil(taken / size)))")))
    takes = takes.withColumns({"_shard": F.get("shards", F.col("_take") - 1), "rest": F.col("taken") - (F.col("_take") - 1) * F.col("size")})
    # A shard is as many partitions as the session's number allows, each a stretch of its order, so that shards can outgrow a task.
    shards = options.get("shards", SHARDS)
    pieces = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    piece = F.least(F.floor((F.col("local_order") / 2.0**64 + 0.5) * pieces), F.lit(pieces - 1))
    dealt = takes.select("_own", "size", "rest", "_shard", "local_order").repartitionById(shards * pieces, (F.col("_shard") * pieces + piece).cast("int")).sortWithinPartitions("local_order")
    own = F.col("_own")
    words = F.array_remove(F.split(F.regexp_replace(own["text"], f"[{SPACE}]+", " "), " "), "")
    whole = F.col("rest") >= F.col("size")
    dealt = dealt.withColumn("cut_text", F.when(whole, own["text"]).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("rest").cast("int")), " ")))
    made = {"text": F.col("cut_text"), "n_chars": F.when(whole, own["n_chars"]).otherwise(F.length("cut_text").cast("long")) if "n_chars" in docs.columns else None}
    return dealt.select(*[(made[c] if c in made else own[c]).alias(c) for c in docs.columns])
