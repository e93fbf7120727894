"""Multi-party perspective rotation of dialogues.

For every speaker of a conversation the dialogue is rendered with that speaker as assistant and the others as named
users; spans mark what the assistant says.  Turns are numbered by one distributed sort, and rendered in parts of a
fixed number of turns, so a conversation of any length is spread over many rows and tasks; parts joined in order are
the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import TOGETHER, dealt_join, written

PART = 64
#: Roles whose turns are instructions and not a speaker's.
INSTRUCTIONS = ("system",)
UNKNOWN = "unknown"


def numbered(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` and ``pos``, the place of the turn in its conversation from 0, by turn, role and text.

    One range sort numbers all rows; a conversation's rows lie side by side in it, so the place is the number less that
    of the conversation's first row in the same partition, plus its rows in earlier partitions.  Only these counts,
    one per conversation and partition, meet in a window.
    """
    order = ["conv_id", "turn", "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("gid", F.monotonically_increasing_id())
    ranged = written(ranged, "chat-turns")
    part = F.shiftrightunsigned("gid", 33).alias("part")
    counts = ranged.groupBy("conv_id", part).agg(F.count("*").alias("n"), F.min("gid").alias("least"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("shift"))
    left, right = ranged.withColumn("part", F.shiftrightunsigned("gid", 33)).alias("l"), base.alias("r")
    on = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.part") == F.col("r.part"))
    return left.join(right, on).select("l.conv_id", "turn", "role", "text", (F.col("gid") + F.col("shift")).alias("pos"))


def rotated(conversations: DataFrame, part: int = PART, instructions: tuple[str, ...] = INSTRUCTIONS, together: int = TOGETHER) -> DataFrame:
    """One row ``(conv_id, speaker, part, n_turns, text, masks)`` per speaker of a conversation and part of ``part`` turns.

    ``masks``: spans ``{start, end}`` of the part's text, in code points, of what the speaker says with the mark that
    ends it.  Turns stand in the order of turn, role, text; exact repeats of a turn count once.  A null role is
    ``unknown``, a null text empty, a null turn comes first, and rows with a null conv_id are one conversation.
    Marks in texts and names are written ``<\\|`` and names are one line, so no turn can end another or speak for someone.
    ``instructions`` are rendered as such and have no perspective; a conversation of those alone has no row.  An empty
    table gives an empty result; other columns are not read.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    placed = numbered(turns)
    speakers = turns.where(~F.col("role").isin(*instructions)).select("conv_id", F.col("role").alias("speaker")).distinct()
    blocks = placed.groupBy("conv_id", F.floor(F.col("pos") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    # A structure, since a null conv_id is a conversation too; one with very many parts is dealt to several keys.
    key = F.struct("conv_id").alias("_conv")
    parts = turns.groupBy(key).agg(F.ceil(F.count("*") / part).alias("n"))
    each = dealt_join(blocks.withColumn("_conv", key), speakers.select(key, "speaker").join(parts, "_conv"), "_conv", together).drop("_conv")

    def plain(x):
        return F.replace(x, F.lit("<|"), F.lit("<\\|"))

    def head(t):
        return (F.when(t["role"].isin(*instructions), F.concat(F.lit("<|"), t["role"], F.lit("|>\n")))
                .when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n"))
                .otherwise(F.concat(F.lit("<|user|>"), F.translate(plain(t["role"]), "\n", " "), F.lit("\n"))))

    said = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(plain(t["text"]), F.lit("<|end|>\n")).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    each = each.withColumn("said", said)
    spans = F.aggregate(
        "said", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
            F.when(t["own"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"]) - 1).alias("end")))))
            .otherwise(a["spans"]).alias("spans")))["spans"]
    return each.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"),
                       F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"])), "").alias("text"), spans.alias("masks"))
