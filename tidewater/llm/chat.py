"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, seq, kind, message, role, text):
  delta       appends text to message `message` (the first one starts it and gives its role);
  edit        replaces what the message says so far;
  regenerate  drops what the message says so far and every later message of the conversation; the
              deltas that follow say it anew.
The events of a conversation are sorted by seq and folded into final messages, in the order of
`message`, and these are rendered as

  <|turn|>role<|say|>text<|end|>

Inside roles and texts every backslash is doubled, and a backslash is put behind the first character
of any control string, of this template or another's (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`):
removing one backslash before any character undoes it, and no control string stays inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
CONTROL = r"<(?=/?s>|\|)|\[(?=/?INST\])"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text)) from an event log.

    Events without a conversation form one of their own; null texts and roles are empty; events of
    the same seq apply in the order of kind, message, role and text; a null kind is a delta, a null
    message sorts first. Only what a conversation's result needs meets in one row.
    """
    event = F.struct(
        "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    logs = log.groupBy("conv_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    place = lambda e: F.coalesce(e["message"], F.lit(-(1 << 62)))

    def final(events: Column) -> Column:
        # where each message was last rewritten, and where a later regeneration of it or an earlier one dropped it
        at = F.transform(events, lambda e, i: F.struct(place(e).alias("message"), i.alias("i"), e["kind"].alias("kind"), e["role"].alias("role"), e["text"].alias("text")))
        resets = F.filter(at, lambda e: e["kind"] != "delta")

        def alive(e: Column, resets: Column) -> Column:
            return ~F.exists(resets, lambda r: (r["i"] > e["i"]) & ((r["message"] == e["message"]) | ((r["kind"] == "regenerate") & (r["message"] < e["message"]))))

        kept = let(resets, lambda r: F.when(F.size(r) == 0, at).otherwise(F.filter(at, lambda e: alive(e, r))))
        ordered = F.array_sort(F.transform(kept, lambda e: F.struct(e["message"].alias("message"), e["i"].alias("i"), e["role"].alias("role"), e["text"].alias("text"))))

        def messages(s: Column) -> Column:
            begins = F.filter(F.transform(s, lambda e, i: F.when((i == 0) | (F.get(s, i - 1)["message"] != e["message"]), i)), lambda i: i.isNotNull())
            return let(
                begins,
                lambda b: F.transform(
                    b,
                    lambda from_, k: let(
                        F.slice(s, from_ + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - from_),
                        lambda own: F.struct(own[0]["role"].alias("role"), F.array_join(F.transform(own, lambda e: e["text"]), "").alias("text")),
                    ),
                ),
            )

        return let(ordered, messages)

    return logs.select("conv_id", final(F.col("events")).alias("turns"))


def render(folded: DataFrame) -> DataFrame:
    """(conv_id, formatted) from (conv_id, turns). No turns give an empty text; texts of any length are rendered whole."""
    one = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAY), escape(t["text"]), F.lit(END))
    return folded.select("conv_id", F.array_join(F.transform("turns", one), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """The turns (role, text, trained) that a rendered conversation says: none for an empty text, null for null."""
    quoted = lambda s: s.replace("|", r"\|")
    parts = F.slice(F.split(formatted, quoted(TURN)), 2, 1 << 30)
    one = lambda p: let(
        F.split(p, quoted(SAY), 2),
        lambda x: F.struct(
            unescape(x[0]).alias("role"), unescape(F.substring(x[1], F.lit(1), F.length(x[1]) - len(END))).alias("text"), (unescape(x[0]) == TRAINED).alias("trained")
        ),
    )
    return F.transform(parts, one)


def log_of(conversations: DataFrame) -> DataFrame:
    """Stored turns as an event log: each row is one delta that says a whole message.

    Rows with the same conversation and turn are messages of their own, in the order of role and text.
    """
    place = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("rows"))
    return sorted_rows.select("conv_id", F.posexplode("rows").alias("at", "row")).select(
        "conv_id", F.col("at").cast("long").alias("seq"), F.lit("delta").alias("kind"), F.col("at").cast("long").alias("message"), F.col("row.role").alias("role"), F.col("row.text").alias("text")
    )


def format_chats(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns as read back) of each conversation of an event log; an empty log gives no rows."""
    return render(fold(log)).withColumn("turns", parse(F.col("formatted")))


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from the formatted text, in numbers and SHA-256.

    A row a conversation, that without an id included; null roles and texts count as empty, turns of
    equal place, role and text count each; other columns are ignored, no conversations give no rows.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    with_loss = chats.withColumn("_said", said).withColumn("_loss", F.array_join(F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]), ""))
    return with_loss.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("_said").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
