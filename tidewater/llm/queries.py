"""One query for each corpus operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.chat import digests, format_chats, log_of
from tidewater.llm.common import table
from tidewater.llm.decontaminate import contaminated
from tidewater.llm.language import identify
from tidewater.llm.mixing import mix
from tidewater.llm.near_dups import near_dup_groups
from tidewater.llm.oracles import ORACLES
from tidewater.llm.quality import quality
from tidewater.llm.rules import ablations, ledger, quality_rules
from tidewater.llm.sharding import assign
from tidewater.llm.suffix_dedup import repeated_spans
from tidewater.llm.toxicity import toxicity

#: The conversation that the chat contract adds: what its texts say looks like another template's control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"select -1L conv_id, pos turn, role, '{TRICKY}' text from (select posexplode(array('user', 'assistant')) as (pos, role))")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra.select("conv_id", F.col("turn").cast("long"), "role", "text"))
    return digests(format_chats(log_of(rows)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.withColumn("shard_taken", F.array_join(F.col("shard_taken").cast("array<string>"), ","))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def rules_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents")))


def chat_edited_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made of conversations in which every message is typed in part, then edited; each conversation begins with
    messages that a regeneration drops and ends with a message that is said anew, with a mark."""
    said = log_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    last = F.max("message").over(Window.partitionBy("conv_id"))
    event = lambda seq, kind, message, text: F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), message.alias("message"), "role", text.alias("text"))
    at, here = F.col("seq") * 10, F.col("message")
    typed = F.array(event(at, "delta", here, F.substring("text", 1, 5)), event(at + 1, "delta", here, F.lit("|junk")), event(at + 2, "edit", here, F.col("text")))
    again = F.array(event(at + 3, "regenerate", here, F.lit("")), event(at + 4, "delta", here, F.col("text")), event(at + 5, "delta", here, F.lit("!")))
    before = F.array(event(F.lit(-3), "delta", F.lit(99), F.lit("dropped")), event(F.lit(-2), "delta", F.lit(0), F.lit("old")), event(F.lit(-1), "regenerate", F.lit(0), F.lit("")))
    none = F.slice(typed, 1, 0)
    events = F.concat(typed, F.when(here == F.col("last"), again).otherwise(none), F.when(here == 0, before).otherwise(none))
    return digests(format_chats(said.withColumn("last", last).select("conv_id", F.inline(events))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, and two that show more of what a ledger and a log are for."""
    found = (op1_toxicity, op2_minhash_near_dups, op3_chat_format, op4_quality, op5_sharding, op6_quality_rules, op7_decontamination, op8_language_id, op9_source_mixing, op10_suffix_dedup, rules_ablations, chat_edited_log)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """For the others see the brute-force tests: their rows hang on seeds or on what was learned."""
    return dict(ORACLES)
