"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings with a meaning in chat templates; a backslash after the first character breaks them inside texts.
CONTROL = ["<|", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
#: A turn: the role up to the first newline that no backslash protects, then the text. The role's
#: repetitions are possessive, which Java matches in a loop; others take stack for each character.
TURN = r"(?s)<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*?)<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """Doubles backslashes, then breaks each control string with one; null is empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """Inverse of escape(): drops each backslash and keeps what it protects."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One training example for every assistant turn, with all turns before it as context.

    Returns conv_id, target_turn (place of the trained turn, from 0), n_context, formatted,
    loss_start and loss_chars (code points of `formatted`, from 0). Only the target's escaped
    text is under the loss mask. Turns that no assistant turn follows close with one example
    whose mask is empty and whose target_turn is null, so that no turn is lost.

    Null role or text: empty. Turns sort by (turn, role, text), nulls first; repeated rows are
    turns of their own; a null conv_id is one conversation. An empty table gives no rows. The
    conversation is the unit of work: its turns meet in one row, as every example must hold its
    whole context. Only the four named columns are read, so extra columns cannot clash.
    """
    item = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(item)).alias("turns"))
    # a newline ends the role's line, so one inside a role is protected as well
    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    part = grouped.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", head).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    last = F.size("roles") - 1
    targets = part.withColumn("at", F.explode(F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("roles", i) == "assistant") | (i == last))))
    at, body = F.col("at"), F.get("bodies", F.col("at"))
    trained = F.get("roles", at) == "assistant"
    whole = F.transform(F.arrays_zip("heads", "bodies"), lambda s: F.concat(s["heads"], s["bodies"], F.lit(CLOSE)))
    shown = targets.select(
        "conv_id",
        F.when(trained, at).alias("target_turn"),
        at.alias("n_context"),
        F.array_join(F.slice(whole, F.lit(1), at), "").alias("prefix"),
        F.get("heads", at).alias("head"),
        body.alias("body"),
        trained.alias("trained"),
    )
    return shown.select(
        "conv_id",
        "target_turn",
        "n_context",
        F.concat("prefix", "head", "body", F.lit(CLOSE)).alias("formatted"),
        (F.length("prefix") + F.length("head")).alias("loss_start"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its formatted examples say: turns are parsed from the longest one."""
    masked = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars")))
    whole = F.max_by("formatted", "n_context")
    got = examples.groupBy("conv_id").agg(
        whole.alias("whole"),
        F.array_sort(F.collect_list(F.struct(F.col("n_context"), masked.alias("said")))).alias("said"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    names, texts = (F.regexp_extract_all("whole", F.lit(TURN), k) for k in (1, 2))
    parsed = got.select("conv_id", names.alias("names"), texts.alias("texts"), F.array_join(F.transform("said", lambda s: s["said"]), "").alias("loss"), "formatted_chars")
    lines = F.zip_with("names", "texts", lambda r, t: F.concat(unescape(r), F.lit("\n"), unescape(t), F.lit("\n")))
    return parsed.select(
        "conv_id",
        F.size("names").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
