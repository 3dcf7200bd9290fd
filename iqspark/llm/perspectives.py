"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def rotate(conversations: DataFrame, part_turns: int | None = None) -> DataFrame:
    """For each conversation and participant, the dialogue with that speaker as assistant and the others as named users.

    conversations: conv_id, turn, role (the speaker), text. Participants are the distinct non-null speakers but system,
    whose turns stay system turns in every rendering. Result, one row for each (conv_id, participant): n_turns, n_target
    (turns to learn), rendered, spans (start:end of each text to learn, in characters of rendered, joined by commas),
    masks (1 for each turn to learn, else 0). A turn is <|system|>, <|assistant|> or <|user name=speaker|>, a line feed,
    its text, <|end|> and a line feed; <| and |> within a speaker's name or a text are written <\\| and |\\>, so that no
    text makes a turn. part is 0; with part_turns, a dialogue is rendered in parts of so many turn numbers (part = turn
    div part_turns, null turns -1), each by itself. Null texts are empty, a null speaker is the user named unknown, null
    turns come first; ties of turn are in the order of speaker and text, repeated rows stay repeated, rows of a null
    conv_id are one conversation. Extra columns are ignored. Built-in functions only.
    """
    plain = lambda c: F.replace(F.replace(c, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))
    part = F.lit(0) if part_turns is None else F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        part.cast("long").alias("part"),
        F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), plain(F.coalesce("text", F.lit(""))).alias("text")).alias("t"),
    )
    speakers = conversations.where("role IS NOT NULL AND role != 'system'").select(F.col("conv_id").cast("long").alias("c"), F.col("role").alias("participant")).distinct()
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    pairs = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    head = lambda t: F.when(t["role"] == F.col("participant"), F.lit("<|assistant|>\n")).when(t["role"] == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), plain(t["role"]), F.lit("|>\n")))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["role"] == F.col("participant")).alias("own")))
    # Starts by a running sum of lengths, as one fold over the part.
    placed = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["text"]) + 8).alias("at"),
            F.when(p["own"], F.concat(a["spans"], F.array(F.concat_ws(":", a["at"] + F.length(p["head"]), a["at"] + F.length(p["head"]) + F.length(p["text"]))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: F.array_join(a["spans"], ","),
    )
    return pairs.withColumn("pieces", pieces).select(
        "conv_id",
        "participant",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_target"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit("<|end|>\n"))), "").alias("rendered"),
        placed.alias("spans"),
        F.array_join(F.transform("pieces", lambda p: F.when(p["own"], F.lit("1")).otherwise(F.lit("0"))), "").alias("masks"),
    )
