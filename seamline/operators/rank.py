"""Candidates: lexical scores, one hop of the graph, six signals, duplicates out, shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.config import DEPENDENCY, SAME_DIRECTORY, SAME_TOP_LEVEL, SIGNALS, RetrievalConfig
from seamline.functions import text as T
from seamline.lineage import cut
from seamline.operators import graph as G
from seamline.operators import score as S


def select_seeds(scores: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The best positive scores of each task, with their rank."""
    return S.top_k(scores, config.expansion.seed_count).where("total > 0")


def capped_expansion(options: DataFrame, per_seed: int, most: int) -> DataFrame:
    """task_id, chunk_id, seed_id, relation, confidence, evidence of what seeds take.

    `options` has task_id, seed_rank, seed_id, place, chunk_id, relation, confidence, evidence.
    Seeds take in rank order, at most per_seed each and `most` in all, each chunk once; what a full
    seed leaves stays free for the next. A seed needs no more than its first per_seed + most
    distinct options: of these at most `most` can be taken by earlier seeds. So one bounded row a
    task is folded.
    """
    by_chunk = Window.partitionBy("task_id", "seed_rank", "chunk_id").orderBy("place")
    distinct = options.withColumn("again", F.row_number().over(by_chunk)).where("again = 1")
    near = Window.partitionBy("task_id", "seed_rank").orderBy("place", "chunk_id")
    few = distinct.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= per_seed + most)
    item = F.struct("seed_rank", "nth", "chunk_id", "seed_id", "relation", "confidence", "evidence")
    lists = few.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def take(acc: Column, x: Column) -> Column:
        fresh = ~F.exists(acc, lambda t: t["chunk_id"] == x["chunk_id"])
        room = (F.size(acc) < most) & (F.size(F.filter(acc, lambda t: t["seed_rank"] == x["seed_rank"])) < per_seed)
        return F.when(fresh & room, F.concat(acc, F.array(x))).otherwise(acc)

    taken = lists.select("task_id", F.explode(F.aggregate("items", F.slice("items", 1, 0), take)).alias("t"))
    return taken.select("task_id", *(F.col(f"t.{c}").alias(c) for c in ("chunk_id", "seed_id", "relation", "confidence", "evidence")))


def expansion_options(seeds: DataFrame, near: DataFrame, linked: DataFrame, chunks: DataFrame) -> DataFrame:
    """What seeds may take: graph neighbours first, then chunks of linked test files."""
    s = seeds.select("task_id", F.col("rank").alias("seed_rank"), F.col("chunk_id").alias("seed_id"), F.col("file").alias("seed_file"))
    by_edge = s.join(near, s["seed_id"] == near["id"]).select(
        "task_id",
        "seed_rank",
        "seed_id",
        F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), near["place"].alias("c"), F.lit("").alias("d")).alias("place"),
        F.col("other").alias("chunk_id"),
        F.lit("dependency").alias("relation"),
        "confidence",
        "evidence",
    )
    own = chunks.select(F.col("file").alias("linked"), F.col("id").alias("chunk_id"), "start_line")
    by_test = s.join(linked, s["seed_file"] == linked["file"]).join(own, "linked").select(
        "task_id",
        "seed_rank",
        "seed_id",
        F.struct((F.col("side") + 1).alias("a"), F.col("linked").alias("b"), F.col("start_line").alias("c"), F.col("chunk_id").alias("d")).alias("place"),
        "chunk_id",
        F.lit("test").alias("relation"),
        F.lit("heuristic").alias("confidence"),
        F.concat(F.lit("file linked to "), "seed_file", F.lit(" by test naming")).alias("evidence"),
    )
    return by_edge.unionByName(by_test)


def proximity(file: Column, best: Column) -> Column:
    """Nearness to the best seed's file: same directory, same top level, or neither."""
    return F.when(best.isNull(), 0.0).when(T.directory_of(file) == T.directory_of(best), SAME_DIRECTORY).when(T.top_level_of(file) == T.top_level_of(best), SAME_TOP_LEVEL).otherwise(0.0)


def rank_candidates(terms: DataFrame, scores: DataFrame, edges: DataFrame, chunks: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Lexical candidates and expansions with all six signals, total and origin, not cut or deduplicated."""
    seeds = cut(select_seeds(scores, config))
    near, linked = cut(G.neighbors(edges, chunks)), cut(G.linked_files(edges))
    seed_keys = F.broadcast(seeds.select("task_id", F.col("rank").alias("seed_rank"), F.col("chunk_id").alias("seed_id"), F.col("file").alias("seed_file")))  # at most seed_count rows a task
    strength = F.when(F.col("confidence") == "exact", DEPENDENCY["exact"]).otherwise(DEPENDENCY["heuristic"])
    dependency = near.join(seed_keys, F.col("id") == F.col("seed_id")).groupBy("task_id", F.col("other").alias("chunk_id")).agg(F.max(strength).alias("dep"))
    tested = linked.join(seed_keys, F.col("file") == F.col("seed_file")).select("task_id", F.col("linked").alias("file"), F.lit(1.0).alias("tested")).distinct()

    options = expansion_options(seeds, near, linked, chunks).join(scores.select("task_id", "chunk_id"), ["task_id", "chunk_id"], "left_anti")
    expanded = cut(capped_expansion(options, config.expansion.max_neighbors_per_seed, config.expansion.max_expanded))
    place = chunks.select(F.col("id").alias("chunk_id"), "file", "start_line", "end_line")
    added = expanded.join(place, "chunk_id").select("task_id", "chunk_id", "file", "start_line", "end_line", *(F.lit(0.0).alias(s) for s in SIGNALS[:3]), F.concat(F.lit("expanded-from:"), "seed_id").alias("origin"))
    direct = scores.select("task_id", "chunk_id", "file", "start_line", "end_line", *SIGNALS[:3], F.lit("direct").alias("origin"))

    best = seed_keys.where("seed_rank = 1").select("task_id", F.col("seed_file").alias("best_file"))
    is_seed = seed_keys.select("task_id", F.col("seed_id").alias("chunk_id"), F.lit(True).alias("is_seed"))
    rows = direct.unionByName(added).join(dependency, ["task_id", "chunk_id"], "left").join(tested, ["task_id", "file"], "left")
    rows = rows.join(F.broadcast(best), "task_id", "left").join(F.broadcast(is_seed), ["task_id", "chunk_id"], "left").join(F.broadcast(S.demotion(terms, config)), "task_id")
    factor = F.when(F.col("is_seed"), 0.0).when(T.is_test_file("file"), F.col("demotion")).otherwise(1.0)
    graph = {"dependency": F.coalesce("dep", F.lit(0.0)), "test": F.coalesce("tested", F.lit(0.0)), "proximity": proximity(F.col("file"), F.col("best_file"))}
    signals = rows.select("task_id", "chunk_id", "file", "start_line", "end_line", "origin", *SIGNALS[:3], *((v * factor).alias(k) for k, v in graph.items()))
    return signals.withColumn("total", S.total(config.weights))


def dedupe_by_rank(ranked: DataFrame) -> DataFrame:
    """The best candidate of each task, file and range."""
    same = Window.partitionBy("task_id", "file", "start_line", "end_line").orderBy(*S.rank_order())
    return ranked.withColumn("again", F.row_number().over(same)).where("again = 1").drop("again")


def shortlist(candidates: DataFrame, chunks: DataFrame, terms: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The best shortlist_size of each task. A corpus with no more chunks than that is taken whole,
    unranked ones last in plain path order. Adds rank."""
    best = S.top_k(candidates, config.shortlist_size)
    if chunks.limit(config.shortlist_size + 1).count() > config.shortlist_size:
        return best
    place = chunks.select(F.col("id").alias("chunk_id"), "file", "start_line", "end_line")
    pairs = F.broadcast(terms.select("task_id")).join(place)  # at most shortlist_size chunks a task
    rest = pairs.join(candidates.select("task_id", "chunk_id"), ["task_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("task_id").orderBy("file", "start_line", "chunk_id")
    unranked = rest.withColumns({"origin": F.lit("unranked"), **{s: F.lit(0.0) for s in SIGNALS}, "total": F.lit(0.0), "rank": F.row_number().over(order) + config.shortlist_size})
    return best.unionByName(unranked)


def shortlist_warnings(best: DataFrame, terms: DataFrame, config: RetrievalConfig) -> DataFrame:
    """task_id, warning of tasks whose shortlist is empty or weak."""
    top = best.groupBy("task_id").agg(F.max("total").alias("best"), F.count("*").alias("n"))
    rows = terms.select("task_id").join(top, "task_id", "left")
    empty = F.lit("No chunk matched the task, so there is nothing to judge; try naming files, symbols or behavior from the code")
    weak = F.format_string(f"Weak shortlist: the best of %d candidates scores %.2f, below {config.weak_shortlist_total}; the task shares little with the code, so the result may be poor", "n", "best")
    return rows.select("task_id", F.when(F.col("n").isNull(), empty).when(F.col("best") < config.weak_shortlist_total, weak).alias("warning")).where("warning is not null")


def blend_scores(rows: DataFrame, weight: float) -> DataFrame:
    """relevance plus weight times the deterministic total over its task's largest; for evaluation only."""
    most = F.max("total").over(Window.partitionBy("task_id"))
    return rows.withColumn("blended", F.col("relevance") + F.lit(float(weight)) * F.when(most > 0, F.col("total") / most).otherwise(0.0))
