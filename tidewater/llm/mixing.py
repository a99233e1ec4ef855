"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Each source's target is its weighted share of `share` times all words, but at most `cap` times its
   own; what is cut off is shared out again by weight until no source is above (solved in one pass
   over sources sorted by the ratio of cap to weight).
2. Targets are apportioned in blocks of equal length. Block for block goes to the source with the
   highest quotient target / (2 k + 1); the first M blocks of that order are, for every M, the
   apportionment of M blocks, so cutting the order into equal runs gives every shard its own quotas.
3. A source's documents stand in a seeded order, their words end to end and cut into blocks. The shards
   take their quotas of that order one after the other, from its beginning again when it is used up, so
   every block is taken as often as any other or once more. A document's words in the mix, and each
   shard's part of them, follow from its place alone: no list of blocks is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, Scratch

#: A source's order is cut into so many runs at least, for each of which the whole table has RUN_ROWS rows
#: at most (on average); so a hot source is many tasks, however large the table.
RUNS, RUN_ROWS = 256, 1 << 16
#: The smallest target has so many blocks at least; all targets together have MOST_BLOCKS at most.
FINEST, MOST_BLOCKS = 256, 1 << 40
WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight, limit and target to (source, source_size), a row a source (by code point, null last).

    Sources are ranked together in one task: a few numbers each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in weights))
    rows = sources.withColumn("at", F.row_number().over(order)).withColumn("weight", F.get(cycle, (F.col("at") - 1) % len(weights)))
    rows = rows.withColumn("limit", F.col("source_size") * cap)
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), "at")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("_spent", F.coalesce(F.sum("limit").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(everything) * share)
        .withColumn("_level", (F.col("_all") - F.col("_spent")) / F.col("_left"))
    )
    fits = F.col("_level") * F.col("weight") <= F.col("limit")
    level = F.first(F.when(fits, F.col("_level")), ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).drop("_spent", "_left", "_all", "_level")


def apportion(rows: DataFrame, shards: int) -> DataFrame:
    """Adds block (words), quota (blocks) and shard_quotas to rows with a target."""
    everything = Window.partitionBy()
    total = F.sum("target").over(everything)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    rows = rows.withColumn("block", F.greatest(F.lit(1), F.floor(F.coalesce(least, F.lit(1.0)) / FINEST), F.ceil(total / MOST_BLOCKS)).cast("long"))
    rows = rows.withColumn("_seats", F.round(total / F.col("block")).cast("long"))
    per_shard = rows.select("at", "target", "_seats", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard"))
    per_shard = per_shard.withColumn("house", F.floor(F.col("_seats") * F.col("shard") / F.lit(shards)).cast("long"))
    house = Window.partitionBy("shard")
    whole = F.sum("target").over(house)
    fair = F.col("target") * F.col("house") / whole
    near = per_shard.withColumn("_near", F.when(whole > 0, F.floor(fair + 0.5)).otherwise(0).cast("long"))
    near = near.withColumn("_off", F.abs(F.sum("_near").over(house) - F.col("house")))
    # seats that may change hands: in proportion to the target, and two more
    near = near.withColumn("_reach", F.when(F.col("target") > 0, F.ceil(F.col("_off") * F.col("target") / whole) + 2).otherwise(0).cast("long"))
    near = near.withColumn("_sure", F.greatest(F.lit(0), F.col("_near") - F.col("_reach")))
    near = near.withColumn("_open", F.col("house") - F.sum("_sure").over(house))
    seats = near.where("_reach > 0").withColumn("seat", F.explode(F.sequence(F.col("_sure"), F.col("_near") + F.col("_reach"))))
    quotient = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("seat") + 1)), "at")
    won = seats.withColumn("rank", F.row_number().over(quotient)).where(F.col("rank") <= F.col("_open")).groupBy("shard", "at").agg(F.count("*").alias("more"))
    houses = near.join(won, ["shard", "at"], "left").select("shard", "at", (F.col("_sure") + F.coalesce("more", F.lit(0))).alias("held"))
    quotas = houses.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("shard", "held"))).alias("houses"))
    ends = F.transform("houses", lambda h: h["held"])
    step = F.transform("houses", lambda h, i: h["held"] - F.coalesce(F.get(F.col("houses"), i - 1)["held"], F.lit(0)))
    return rows.drop("_seats").join(quotas.select("at", F.element_at(ends, -1).alias("quota"), step.alias("shard_quotas")), "at")


def placed(docs: DataFrame, share: float, cap: float, seed: int, shards: int, carry: list[Column]) -> DataFrame:
    """(doc_id, source, what is carried, size, source_size, target, block, quota, shard_quotas, _start, _stop):
    the document's words are those from _start to _stop of its source's order."""
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    bits = (max(docs.count() // RUN_ROWS, RUNS) - 1).bit_length()
    run = F.shiftright(F.conv(F.substring("_key", 1, 12), 16, 10).cast("long"), 48 - bits)
    # a null source has its own key, so that windows and joins share one partitioning
    named = [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), key.alias("_key")]
    sized = docs.select("doc_id", "source", *carry, *named, size.alias("size")).withColumn("_run", run)
    if not carry:
        sized = scratch.cut(sized)
    runs = scratch.cut(sized.groupBy("_s", "_n", "_run").agg(F.sum("size").alias("_words")))
    own_runs = Window.partitionBy("_s", "_n")
    runs = runs.withColumn("source_size", F.sum("_words").over(own_runs)).withColumn("_before", F.sum("_words").over(own_runs.orderBy("_run")) - F.col("_words"))
    sources = runs.select("_s", "_n", "source_size").distinct().withColumn("source", F.when(~F.col("_n"), F.col("_s")))
    plan = scratch.cut(apportion(targets(sources, share, cap), shards).select("_s", "_n", "target", "block", "quota", "shard_quotas"))
    plan = runs.join(plan, ["_s", "_n"]).drop("_words")
    own = Window.partitionBy("_s", "_n", "_run").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("_end", F.sum("size").over(own)).join(plan, ["_s", "_n", "_run"])
    return rows.withColumn("_stop", F.col("_before") + F.col("_end")).withColumn("_start", F.col("_stop") - F.col("size"))


def rounds(quota: Column) -> tuple[Column, Column]:
    """(how often a quota takes the whole order, words of the order that it takes once more)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))).cast("long")
    whole = F.floor(quota / blocks).cast("long")
    return whole, (quota - whole * blocks) * F.col("block")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 20, shards: int = 16) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shard_taken) for each row of docs (doc_id, text, source).

    A text's size is its number of words (null: 0); a null source is a source of its own, sorted last.
    shard_taken holds the document's words that each shard's quota takes, repeats included, taken their
    sum, at most `cap` (whole) times the size; each source gives its target to within some blocks (a
    target has FINEST of them), and reruns agree. Rows without doc_id and rows that repeat one are
    documents of their own; of equal rows, which one gives what is of no account. A very long text is as
    many blocks as it has words for. An empty table gives an empty one. Other columns are ignored, so
    none can clash.
    """
    rows = placed(docs, share, cap, seed, shards, [])
    # before each shard: the quotas of those before it
    ends = F.transform("shard_quotas", lambda q, i: F.aggregate(F.slice("shard_quotas", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))

    def words(quota: Column) -> Column:
        whole, more = rounds(quota)
        return F.least(whole * F.col("size") + F.least(F.col("_stop"), more) - F.least(F.col("_start"), more), F.col("size") * int(cap))

    rows = rows.withColumn("_words", F.transform(ends, words))
    each = F.transform("_words", lambda w, i: (w - F.coalesce(F.get(F.col("_words"), i - 1), F.lit(0))).cast("long"))
    sizes = [F.col("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target")]
    return rows.select("doc_id", "source", *sizes, F.element_at("_words", -1).cast("long").alias("taken"), each.alias("shard_taken"))


def mixed(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 20, shards: int = 16) -> DataFrame:
    """docs in the mix, as whole documents; columns, whatever their names, as in docs.

    A document comes as often as its source's quota takes the whole order, and once more if its middle
    word stands in what the quota takes beyond: so a source misses its quota by half of one document at
    most, and no document comes more than `cap` times. Documents without words (null texts too) stay
    once. Nulls, repeated rows, long texts and empty tables are treated as by mix().
    """
    rows = placed(docs, share, cap, seed, shards, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document")])
    whole, more = rounds(F.col("quota"))
    times = F.least(whole + F.when(F.col("_start") + F.col("_stop") < 2 * more, 1).otherwise(0), F.lit(int(cap)))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(times).cast("int")
    return rows.withColumn("_times", times).where("_times > 0").select("_document", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_document.*")
