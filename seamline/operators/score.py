"""Lexical signals of chunks for tasks: names, text and paths, each in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.config import BASENAME_BONUS, PARTIAL_NAME_CEILING, SIGNALS, RetrievalConfig
from seamline.functions import text as T
from seamline.operators import index as ix

LEXICAL = SIGNALS[:3]


def named_terms(terms: DataFrame) -> DataFrame:
    """task_id, term: exact terms and joined variants."""
    return terms.select("task_id", F.explode(F.concat("exact", "variants")).alias("term"))


def probes(terms: DataFrame, double_stem: bool = True) -> DataFrame:
    """task_id, term, word: stems under which a task word is looked up among names and paths. Task
    words are stemmed already; the lookup stems them again unless double_stem is off."""
    stem = (lambda w: T.stem(w)) if double_stem else (lambda w: w)
    words = terms.select("task_id", F.explode("words").alias("term"))
    return words.select("task_id", "term", F.explode(F.transform(T.split_identifier("term"), stem)).alias("word")).distinct()


def partial_name_score(name: Column, words: Column) -> Column:
    """Share of the last member's distinct words that the task mentions, favouring more of them."""
    own = F.array_distinct(T.stemmed_words(T.last_member(name)))
    covered = F.size(F.array_intersect(own, words))
    return F.when(covered > 0, PARTIAL_NAME_CEILING * covered * covered / (F.size(own) * (covered + 1))).otherwise(0.0)


def symbol_signals(terms: DataFrame, chunks: DataFrame, double_stem: bool = True) -> DataFrame:
    """task_id, chunk_id, symbol: 1 for an exact name, else the partial score of names sharing a word."""
    keys = named_terms(terms).select("task_id", F.explode(T.exact_keys("term")).alias("key")).distinct()
    exact = keys.join(ix.symbol_keys(chunks), "key").select("task_id", "chunk_id", F.lit(1.0).alias("symbol"))
    near = probes(terms, double_stem).select("task_id", "word").distinct().join(ix.symbol_words(chunks), "word").select("task_id", "chunk_id").distinct()
    named = chunks.where("name <> ''").select(F.col("id").alias("chunk_id"), "name")
    partial = near.join(named, "chunk_id").join(terms.select("task_id", "words"), "task_id").select("task_id", "chunk_id", partial_name_score(F.col("name"), F.col("words")).alias("symbol"))
    return exact.unionByName(partial).groupBy("task_id", "chunk_id").agg(F.max("symbol").alias("symbol")).where("symbol > 0")


def lexical_signals(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """task_id, chunk_id, lexical: BM25 over words and related words, divided by the task's best."""
    query = terms.select("task_id", F.explode(F.concat("words", "related")).alias("term"))
    scores = ix.bm25(chunks, query)
    best = scores.groupBy("task_id").agg(F.max("score").alias("best")).where("best > 0")
    return scores.join(best, "task_id").select("task_id", "chunk_id", (F.col("score") / F.col("best")).alias("lexical"))


def path_signals(terms: DataFrame, files: DataFrame, double_stem: bool = True) -> DataFrame:
    """task_id, file, path: share of the task's words in the path, half as much again once for a
    base name, 1 for the path itself."""
    size = terms.select("task_id", F.size("words").alias("size"))
    hits = probes(terms, double_stem).join(ix.path_words(files), "word").groupBy("task_id", "file").agg(F.count_distinct("term").alias("hits"))
    shared = hits.join(size, "task_id").select("task_id", "file", (F.col("hits") / F.col("size")).alias("share"))
    said = named_terms(terms).distinct()
    whole = said.where("term like '%/%' or term like '%.%'").join(ix.path_suffixes(files).withColumnRenamed("suffix", "term"), "term").select("task_id", "file", F.lit(1.0).alias("share"))
    based = said.select("task_id", F.lower("term").alias("key")).distinct().join(ix.basenames(files), "key").select("task_id", "file").distinct().withColumn("bonus", F.lit(BASENAME_BONUS))
    share = shared.unionByName(whole).groupBy("task_id", "file").agg(F.max("share").alias("share"))
    both = share.join(based, ["task_id", "file"], "full")
    return both.select("task_id", "file", F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("path"))


def total(weights: dict[str, float], of=F.col) -> Column:
    """Weighted sum of the six signals, added in their fixed order."""
    out = F.lit(0.0)
    for s in SIGNALS:
        out = out + F.lit(float(weights.get(s, 0.0))) * of(s)
    return out


def demotion(terms: DataFrame, config: RetrievalConfig) -> DataFrame:
    """task_id, demotion: factor on test files, 1 where the task is about tests."""
    return terms.select("task_id", F.when(F.col("mentions_tests"), 1.0).otherwise(float(config.test_demotion)).alias("demotion"))


def score_chunks(terms: DataFrame, chunks: DataFrame, config: RetrievalConfig, double_stem: bool = True) -> DataFrame:
    """task_id, chunk_id, file, start_line, end_line, the six signals, total: chunks that any lexical
    signal matches. The lexical maximum is taken before test files are demoted."""
    place = chunks.select(F.col("id").alias("chunk_id"), "file", "start_line", "end_line")
    path = path_signals(terms, ix.files_of(chunks), double_stem).join(place.select("chunk_id", "file"), "file").select("task_id", "chunk_id", "path")
    parts = [symbol_signals(terms, chunks, double_stem), lexical_signals(terms, chunks), path]
    rows = None
    for name, part in zip(LEXICAL, parts, strict=True):
        one = part.select("task_id", "chunk_id", *((F.col(s) if s == name else F.lit(0.0).alias(s)) for s in LEXICAL))
        rows = one if rows is None else rows.unionByName(one)
    merged = rows.groupBy("task_id", "chunk_id").agg(*(F.max(s).alias(s) for s in LEXICAL))
    placed = merged.join(place, "chunk_id").join(F.broadcast(demotion(terms, config)), "task_id")
    factor = F.when(T.is_test_file("file"), F.col("demotion")).otherwise(1.0)
    scored = placed.select("task_id", "chunk_id", "file", "start_line", "end_line", *((F.col(s) * factor).alias(s) for s in LEXICAL), *(F.lit(0.0).alias(s) for s in SIGNALS[3:]))
    return scored.withColumn("total", total(config.weights)).where("total > 0")


def rank_order(total: str = "total") -> list[Column]:
    """Best first; then by file (as a reader sorts), start line and id."""
    return [F.col(total).desc(), F.collate(F.col("file"), "UNICODE").asc(), F.col("file").asc(), F.col("start_line").asc(), F.col("chunk_id").asc()]


def top_k(scores: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The k first rows of each task, with their rank. Spark keeps k rows a task before it shuffles."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(*(order or rank_order()))))
    return ranked.where(F.col("rank") <= k)


def lexical_baseline(terms: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """BM25 over words alone, k best of each task."""
    scores = ix.bm25(chunks, terms.select("task_id", F.explode("words").alias("term")))
    place = chunks.select(F.col("id").alias("chunk_id"), "file", "start_line", "end_line")
    return top_k(scores.withColumnRenamed("score", "total").join(place, "chunk_id"), k)
