"""Chat formatting: every participant's view of a dialogue, with DataFrame functions only.

For each conversation and each participant (a speaker that isn't the system), the dialogue is
rendered once with that speaker as the assistant: own turns are assistant turns under the loss mask,
other speakers' turns are user turns that name them, system turns stay as they are. A rendered turn
is "<|role|>" with " name=..." for others, a line feed, the text, "<|end|>" and a line feed; the mask
covers text and end mark of own turns.

A conversation can be long or hot, so nothing gathers it whole: turns are put into chunks of CHUNK
turn numbers, each chunk is rendered by itself, and character offsets come from sums over chunks.
One row per (conversation, perspective, chunk): text, start (code points before the chunk in the
whole rendering), masks (own spans [start, end) within the chunk), n_turns, n_own.

Defined cases: null speakers are named "unknown"; null texts are empty; turns order by number (null
last), then speaker, then text; repeated rows are rendered as often as they occur; rows without a
conversation id form one conversation; conversations of system turns alone have no perspective; an
empty table gives no rows; other input columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import read

CHUNK = 256
END = "<|end|>\n"


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
                 text_col: str = "text", system: str = "system") -> DataFrame:
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit((1 << 62) // CHUNK)))
    people = t.where(F.col("speaker") != system).select(F.col("conv_id").alias("_conv"),
                                                        F.col("speaker").alias("perspective")).distinct()
    own, is_system = F.col("speaker") == F.col("perspective"), F.col("speaker") == system
    head = (F.when(own, F.lit("<|assistant|>\n")).when(is_system, F.lit("<|system|>\n"))
            .otherwise(F.concat(F.lit("<|user|> name="), F.col("speaker"), F.lit("\n"))))
    rows = (t.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
            .select("conv_id", "perspective", "chunk", "turn", "speaker", "text", own.alias("own"), head.alias("head"))
            .withColumn("part", F.concat("head", "text", F.lit(END))))
    # inside a chunk: turns in order, each with its place from the sizes before it
    entry = F.struct(F.col("turn").isNull().alias("late"), "turn", "speaker", "text", "own", "part",
                     F.length("head").alias("skip"), F.length("part").alias("size"))
    chunked = rows.groupBy("conv_id", "perspective", "chunk").agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    placed = F.aggregate(
        "turns", F.struct(F.lit(0).cast("long").alias("at"),
                          F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks")),
        lambda a, x: F.struct(
            (a["at"] + x["size"]).alias("at"),
            F.when(x["own"], F.concat(a["masks"], F.array(F.struct(
                (a["at"] + x["skip"]).alias("start"), (a["at"] + x["size"]).alias("end"))))).otherwise(a["masks"]).alias("masks")))
    w = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (chunked.withColumn("p", placed)
            .select("conv_id", "perspective", "chunk",
                    F.array_join(F.transform("turns", lambda x: x["part"]), "").alias("rendered"),
                    F.coalesce(F.sum("p.at").over(w), F.lit(0)).alias("start"), F.col("p.masks").alias("masks"),
                    F.size("turns").cast("long").alias("n_turns"), F.size("p.masks").cast("long").alias("n_own")))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(read(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat(m["start"], F.lit("-"), m["end"])), ",")
    return out.select("conv_id", "perspective", "chunk", "rendered", "start", spans.alias("mask_spans"), "n_turns", "n_own")
