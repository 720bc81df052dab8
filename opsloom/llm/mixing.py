"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The words of a source are dealt to blocks by a hash of the row. A source's quota is the number of its blocks, repeats
counted, that make up its target. The tree splits the vector of quotas exactly between two halves of the output shards,
again and again, by hypergeometric draws, until each shard has its own; the draws say how many blocks of each source a
uniform shuffle of all blocks would put there. A shard then takes the next blocks of each source's random permutation, and
orders its documents by a hash. Each permuted block is drawn once per pass over its source; the last block of a target is
cut at a word.

All steps are DataFrame operations. A source is never gathered, and rows of a block meet only where a target cuts it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.ordered import running_sum
from opsloom.llm.text import SPACE_CLASS, let
from opsloom.session import cut_lineage, work_path

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix has, and the most that a source gives of its own.
SHARE, CAP = 1.5, 2.0
BLOCK_WORDS, BLOCK_ROWS = 50_000, 4_096
SHARD_WORDS = 4_000_000
SEED = 20_240_607

NOT_SPACE = SPACE_CLASS.replace("[", "[^")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) with ``rank`` and ``target``.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``cap`` times its source's size;
    the excess goes to the others by weight until none is above. In order of size per weight the capped sources come
    first, so one pass over that order finds the common level.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("_level", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_level", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_try", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / rest)
    level = F.min(F.when(F.col("_try") <= F.col("_level"), F.struct("_level", "rank", "_try"))).over(every)["_try"]
    return rows.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap")))).select(
        "source", "source_size", "source_rows", "rank", "target")


# --- hypergeometric draws as column expressions ------------------------------------------------

def _log_factorial(x: Column) -> Column:
    """Stirling's series at ``x + 9``, brought back to ``x``."""
    z = x.cast("double") + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    product = F.lit(1.0)
    for k in range(1, 9):
        product = product * (x.cast("double") + float(k))
    return series - F.log(product)


def _hypergeometric(total: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``good`` among ``total`` come with ``drawn`` draws: inverse of the distribution at ``uniform``.

    Sums 12 standard deviations (and 12) on either side of the mean; what lies beyond is under 1e-30.
    """
    low, high = F.greatest(F.lit(0).cast("long"), drawn + good - total), F.least(drawn, good)
    mean = drawn * good / total
    spread = F.sqrt(mean * (total - good) * (total - drawn) / total / F.greatest(total - 1, F.lit(1).cast("long"))) * 12 + 12
    first, last = F.greatest(low, F.floor(mean - spread)), F.least(high, F.ceil(mean + spread))

    def log_chance(x: Column) -> Column:
        return -(_log_factorial(x) + _log_factorial(good - x) + _log_factorial(drawn - x) + _log_factorial(total - good - drawn + x))

    def pick(xs: Column) -> Column:
        logs = F.transform(xs, log_chance)

        def weigh(values: Column) -> Column:
            return let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))

        def choose(chances: Column) -> Column:
            whole = F.aggregate(chances, F.lit(0.0), lambda a, v: a + v)
            limit = whole * uniform
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("passed"))
            walked = let(limit, lambda top: F.aggregate(chances, start, lambda a, v: F.struct(
                (a["sum"] + v).alias("sum"), (a["passed"] + F.when(a["sum"] + v < top, 1).otherwise(0)).alias("passed"))))
            return F.get(xs, F.least(walked["passed"], F.size(xs) - 1))

        return let(let(logs, weigh), choose)

    return F.when((total <= 0) | (high <= low), low).otherwise(let(F.sequence(first, last), pick))


def _uniform(*parts: Column | int) -> Column:
    hashed = F.xxhash64(F.lit(SEED), *[F.lit(p) if isinstance(p, int) else p for p in parts])
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """``(shard, rank, quota)`` from one row with an array ``quotas`` (by source rank): the splitting tree, level by level."""
    nodes = quotas.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "quotas")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level and level % 10 == 0:  # a task of 1,024 nodes deals them out
            nodes = nodes.repartition("low")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        whole = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        share = F.floor(whole * (middle - F.col("low")) / (F.col("high") - F.col("low"))).cast("long")
        start = F.struct(whole.alias("total"), share.alias("drawn"), F.array().cast("array<bigint>").alias("left"))

        def step(acc: Column, quota: Column) -> Column:
            number = F.size(acc["left"])
            draw = _hypergeometric(acc["total"], quota, acc["drawn"], _uniform(F.col("low"), F.col("high"), number)).cast("long")
            return let(draw, lambda x: F.struct((acc["total"] - quota).alias("total"), (acc["drawn"] - x).alias("drawn"),
                                                F.concat(acc["left"], F.array(x)).alias("left")))

        left = F.aggregate("quotas", start, step)["left"]
        both = let(left, lambda x: F.array(
            F.struct(F.col("low").alias("low"), middle.alias("high"), x.alias("quotas")),
            F.struct(middle.alias("low"), F.col("high").alias("high"),
                     F.zip_with("quotas", x, lambda q, y: q - y).alias("quotas"))))
        single = F.array(F.struct("low", "high", "quotas"))
        nodes = nodes.select(F.explode(F.when(F.col("high") - F.col("low") > 1, both).otherwise(single)).alias("n")).select("n.*")
    return nodes.select(F.col("low").alias("shard"), F.posexplode("quotas").alias("rank", "quota"))


# --- the mix -----------------------------------------------------------------------------------

def _sized(docs: DataFrame, source: str, text: str, ids: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """``extra`` columns with the row's source, size in words, and place in the order of its source."""
    count = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(NOT_SPACE)).cast("long")
    order = F.xxhash64(F.lit(SEED), *[F.col(c) for c in ids], F.col(text))
    return docs.select(*extra, F.col(source).alias("source"), count.alias("size"), order.alias("order"))


def _block_draws(sized: DataFrame, weights: Sequence[float], share: float, cap: float, block_words: int,
                 shard_words: int) -> tuple[DataFrame, DataFrame]:
    """The sources' targets, and for each block that the mix takes its size ``_all`` and draws (pass, shard, words)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = _stored(source_targets(totals, weights, share, cap).withColumn("blocks", F.greatest(
        F.lit(1).cast("long"), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("source_rows") / BLOCK_ROWS))))
    # One figure: how many shards the targets fill.
    shards = max(1, math.ceil((targets.agg(F.sum("target")).first()[0] or 0) / shard_words))

    blocks = _placed(sized, targets).groupBy("rank", "block").agg(
        F.sum("size").alias("words"), F.max("target").alias("target"), F.max("source_size").alias("source_size"))
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1))
    drawn = blocks.where("words > 0").withColumn("pass", F.explode(passes)).withColumn("shuffled", F.xxhash64(F.lit(SEED), "rank", "pass", "block"))
    # A source's permuted blocks in ranges of the hash, so that no task holds all of them.
    drawn = running_sum(drawn, ["rank"], ["pass", "shuffled", "block"], F.struct("pass", F.shiftright("shuffled", 48)),
                        {"upto": F.col("words"), "number": F.lit(1)})
    drawn = cut_lineage(drawn.withColumn("number", F.col("number") - 1).withColumn("_all", F.col("words")).withColumn(
        "words", F.least(F.col("words"), F.round("target").cast("long") - F.col("upto") + F.col("words"))).where("words > 0"))

    quotas = targets.select("rank").join(drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), "rank", "left")
    vector = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("quota", F.lit(0)).alias("quota")))),
                                    lambda x: x["quota"]).alias("quotas")).where(F.size("quotas") > 0)
    split = running_sum(split_quotas(vector, shards), ["rank"], ["shard"], F.shiftright("shard", 12), {"upto": F.col("quota")})
    numbers = F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)
    taken_by = split.where("quota > 0").select("rank", "shard", F.explode(numbers).alias("number"))
    return targets, cut_lineage(drawn.join(taken_by, ["rank", "number"]).groupBy("rank", "block").agg(
        F.max("_all").alias("_all"), F.array_sort(F.collect_list(F.struct("pass", "shard", "words"))).alias("_draws")))


def _stored(sources: DataFrame) -> DataFrame:
    """One row per source as a written table, whose size Spark knows."""
    path = work_path(sources.sparkSession, "mix-sources")
    sources.coalesce(1).write.parquet(path)
    return sources.sparkSession.read.parquet(path)


def _placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized`` with its source's columns and its block. ``targets`` is a stored table: Spark knows its size and, where the sources
    are few, broadcasts it; then a frequent source meets in no task and texts aren't shuffled for it."""
    joined = sized.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source_rows")
    return joined.withColumn("block", F.pmod("order", F.col("blocks"))).drop("blocks")


def _draw(sized: DataFrame, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with ``source_size``, ``target`` and ``draws``.

    Most blocks are drawn whole, whatever the order of their rows. The one block that ends a source's target is cut: only its
    rows are numbered. That block comes with the source, so that both kinds of rows are told apart before any shuffle, and each
    row is shuffled once.
    """
    cut = plan.where(F.exists("_draws", lambda d: d["words"] < F.col("_all"))).select("rank", F.struct("block", "_draws").alias("_end"))
    placed = _placed(sized, _stored(targets.join(cut, "rank", "left")))
    last = F.col("block").eqNullSafe(F.col("_end.block"))
    kind = "array<struct<pass:int,shard:int,taken:bigint>>"
    # The plan grows with the words: a merge join at every size.
    whole = placed.where(~last).join(plan.hint("merge"), ["rank", "block"], "left").withColumn("draws", F.when(F.col("size") > 0, F.transform(
        "_draws", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.col("size").alias("taken")))))
    ended = placed.where(last).withColumn("_twin", F.monotonically_increasing_id())
    inside = Window.partitionBy("rank", "block").orderBy("order", "_twin").rowsBetween(Window.unboundedPreceding, -1)
    ended = ended.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("draws", F.filter(
        F.transform("_end._draws", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.greatest(
            F.lit(0).cast("long"), F.least(F.col("size"), d["words"] - F.col("_before"))).alias("taken"))), lambda d: d["taken"] > 0))
    both = whole.drop("_all", "_draws").unionByName(ended.drop("_twin", "_before"))
    return both.withColumn("draws", F.coalesce("draws", F.array().cast(kind))).drop("rank", "block", "_end")


def mix_plan(docs: DataFrame, source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS,
             share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
             keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, ``source``, ``size``, ``source_size``, ``target``, ``order`` and ``draws``.

    ``size`` is the number of words; ``draws`` has (pass, shard, taken) for every time the mix takes the document. A
    document is taken at most once per pass, so never more than ``ceil(cap)`` times; a source's taken words sum to its
    rounded target. Null texts have size 0 and are never taken; a null source is a source of its own; the order inside a
    source is a hash of ``keep`` and the text, so reruns agree. Repeated rows are rows of their own.
    An empty table gives no rows.
    """
    sized = cut_lineage(_sized(docs, source, text, keep, keep))
    targets, plan = _block_draws(sized, weights, share, cap, block_words, shard_words)
    return _draw(sized, targets, plan).select(*keep, "source", "size", "source_size", "target", "order", "draws")


def mix(docs: DataFrame, source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        cap: float = CAP, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed rows, shard by shard and shuffled inside each: the columns of ``docs``, with ``text`` cut where a target ends.

    A document that the mix takes twice gives two rows. The blocks are planned without texts; these meet their blocks' draws
    in one shuffle, and their shards in another: written once, and once for each time they are taken.
    """
    columns = docs.columns
    ids = [c for c in columns if c == "doc_id"]
    targets, plan = _block_draws(cut_lineage(_sized(docs, source, text, ids, [])), weights, share, cap, block_words, shard_words)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = _draw(_sized(docs, source, text, ids, [row]), targets, plan).withColumn("draw", F.explode("draws"))
    shuffled = F.xxhash64(F.lit(SEED), "draw.shard", "draw.pass", "order")
    # A word with the white space behind it is one piece; white space at the start is a piece of its own.
    whole = F.col("row").getField(text)
    pieces = F.split(whole, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.regexp_like(whole, F.lit(r"^[\x20\x09-\x0D]")).cast("bigint")
    first = F.array_join(F.slice(pieces, 1, (F.col("draw.taken") + blank).cast("int")), "")
    cut = F.when(F.col("draw.taken") < F.col("size"), first).otherwise(whole)
    rows = rows.select("row", cut.alias("text"), F.col("draw.shard").alias("shard"), shuffled.alias("place"))
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "place")
    return ordered.select(*[F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in columns])
