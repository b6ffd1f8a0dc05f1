"""From judged candidates to regions: threshold, supporting declarations, merged ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.config import MIN_RELEVANCE
from seamline.lineage import cut

SUPPORT_KINDS, TARGET_KINDS = ["type", "extends", "implements"], ["type", "interface", "class"]


def parent_chains(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """id, support_id: all container headers above each wanted chunk (`ids`: id)."""
    links = chunks.where("parent_id is not null and parent_id <> id").select(F.col("id").alias("child"), F.col("parent_id").alias("support_id"))
    known = chunks.select(F.col("id").alias("support_id"))
    links = links.join(known, "support_id", "left_semi")
    level = cut(ids.select("id").distinct().join(links, F.col("id") == F.col("child")).select("id", "support_id"))
    found = level
    while not level.isEmpty():  # ends where no pair is new, also on cycles
        level = cut(level.withColumnRenamed("support_id", "child").join(links, "child").select("id", "support_id").join(found, ["id", "support_id"], "left_anti").where("support_id <> id"))
        found = found.unionByName(level)
    return found.distinct()


def required_supports(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """id, support_id: container headers, and exact type, extends or implements targets that declare a type."""
    refs = chunks.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.explode("references").alias("r"))
    targets = refs.where(F.col("r.kind").isin(SUPPORT_KINDS) & (F.col("r.evidence") == "exact")).select("id", F.col("r.target_chunk_id").alias("support_id"))
    declared = chunks.where(F.col("kind").isin(TARGET_KINDS)).select(F.col("id").alias("support_id"))
    return parent_chains(chunks, ids).unionByName(targets.join(declared, "support_id").where("support_id <> id").select("id", "support_id")).distinct()


def select_by_relevance(judged: DataFrame, chunks: DataFrame, min_score: float = MIN_RELEVANCE) -> tuple[DataFrame, DataFrame]:
    """(selected, skipped) from judged candidates (task_id, chunk_id, score, ...).

    Selected has the eligible ones and the declarations they need (score 0, support_for names who
    needs them). A candidate below the minimum is skipped unless it is somebody's support.
    """
    eligible = judged.where(F.col("score") >= min_score)
    wants = eligible.select("task_id", F.col("chunk_id").alias("id"))
    needed = wants.join(required_supports(chunks, wants), "id").join(eligible.select("task_id", F.col("chunk_id").alias("support_id")), ["task_id", "support_id"], "left_anti")
    names = chunks.select("id", F.coalesce("name", "file").alias("said"))
    supports = needed.join(names, "id").groupBy("task_id", F.col("support_id").alias("chunk_id")).agg(F.array_sort(F.collect_set(F.struct("id", "said"))).alias("by"))
    added = supports.select("task_id", "chunk_id", F.lit(0.0).alias("score"), F.concat(F.lit("Supporting declaration for "), F.array_join(F.transform("by", lambda b: b["said"]), ", ")).alias("reason"), F.transform("by", lambda b: b["id"]).alias("support_for"))
    kept = eligible.select("task_id", "chunk_id", "score", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("array<string>").alias("support_for"))
    skipped = judged.where(F.col("score") < min_score).join(added.select("task_id", "chunk_id"), ["task_id", "chunk_id"], "left_anti")
    return kept.unionByName(added), skipped


def islands(rows: DataFrame, keys: list[str], start: str, end: str, tie: str | None = None) -> DataFrame:
    """Adds `island`: numbers, within keys, runs of ranges that overlap, nest or touch."""
    order = Window.partitionBy(*keys).orderBy(start, end, *([tie] if tie else []))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    return rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge_ranges(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end, members of each merged range."""
    return islands(rows, keys, start, end).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("island")


def line_text(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, text: each line once, from the first chunk that covers it."""
    lines = chunks.select(*keys, F.col("start_line").alias("s"), F.col("end_line").alias("e"), "chunk_id", F.posexplode(F.split("content", "\n", -1)).alias("i", "text"))
    return lines.where(F.col("s") + F.col("i") <= F.col("e")).groupBy(*keys, (F.col("s") + F.col("i")).alias("line")).agg(F.min_by("text", F.struct("s", "e", "chunk_id")).alias("text"))


def merge_regions(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """task_id, file, language, start_line, end_line, content, chunk_ids of merged selected chunks."""
    rows = selected.select("task_id", "chunk_id").join(chunks.select(F.col("id").alias("chunk_id"), "file", "language", "start_line", "end_line", "content"), "chunk_id")
    marked = islands(rows, ["task_id", "file"], "start_line", "end_line", "chunk_id")
    keys = ["task_id", "file", "island"]
    member = F.struct("start_line", "end_line", "chunk_id")
    shape = marked.groupBy(*keys).agg(F.min_by("language", member).alias("language"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.transform(F.array_sort(F.collect_list(member)), lambda m: m["chunk_id"]).alias("chunk_ids"))
    text = line_text(marked, keys).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda l: l["text"]), "\n").alias("content"))
    return shape.join(text, keys).select("task_id", "file", "language", "start_line", "end_line", "content", "chunk_ids")


def region_relevance(regions: DataFrame, judged: DataFrame) -> DataFrame:
    """Adds relevance_key: a region's best judged relevance, else its best score."""
    members = regions.select("task_id", "file", "start_line", F.explode("chunk_ids").alias("chunk_id")).join(judged.select("task_id", "chunk_id", "relevance", "score"), ["task_id", "chunk_id"], "left")
    best = members.groupBy("task_id", "file", "start_line").agg(F.coalesce(F.max("relevance"), F.max("score"), F.lit(0.0)).alias("relevance_key"))
    return regions.join(best, ["task_id", "file", "start_line"])


def region_order() -> list[Column]:
    return [F.col("relevance_key").desc(), F.collate(F.col("file"), "UNICODE"), F.col("file"), F.col("start_line")]


def location_order(id_column: str = "chunk_id") -> list[Column]:
    return [F.collate(F.col("file"), "UNICODE"), F.col("file"), F.col("start_line"), F.col(id_column)]
