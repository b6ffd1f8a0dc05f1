"""Term, symbol and path tables of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.config import B, K1
from seamline.functions import text as T
from seamline.lineage import cut


def postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """chunk_id, term, dl, tf; dl is the chunk's length. With `terms` (term), only those are kept
    before anything is shuffled. A chunk is tokenized once for all of it."""
    split = chunks.select(F.col("id").alias("chunk_id"), T.tokenize("content").alias("tokens"))
    tokens = split.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        tokens = tokens.join(terms.select("term").distinct(), "term", "left_semi")
    return tokens.groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf"))


def wanted_postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """postings() of the wanted terms, and for each chunk a row whose term is empty (no token is), so that
    one pass over the texts gives counts and lengths alike."""
    held = F.concat(F.coalesce(T.tokenize("content"), F.array().cast("array<string>")), F.array(F.lit("")))
    rows = chunks.select(F.col("id").alias("chunk_id"), held.alias("tokens"))
    each = rows.select("chunk_id", (F.size("tokens") - 1).alias("dl"), F.explode("tokens").alias("term"))
    wanted = terms.select("term").where("term <> ''").unionByName(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    return each.join(wanted, "term", "left_semi").groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf"))


def doc_lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, dl: indexed tokens of each chunk, 0 where it has none."""
    return chunks.select(F.col("id").alias("chunk_id"), F.coalesce(F.size(T.tokenize("content")), F.lit(0)).alias("dl"))


def text_stats(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their average length; 0 and 0 for no chunks."""
    return doc_lengths(chunks).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def bm25_term(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    """BM25 of one term in one chunk."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = F.when(avgdl > 0, 1 - B + B * dl / avgdl).otherwise(1.0)
    return idf * tf * (K1 + 1) / (tf + K1 * norm)


def term_scores(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """chunk_id, term, bm25 of each wanted term (column term) in each chunk that has it."""
    both = cut(wanted_postings(chunks, terms))
    found = both.where("term <> ''")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(both.where("term = ''").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")))  # one row
    scored = found.join(df, "term").join(stats)
    return scored.select("chunk_id", "term", bm25_term(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")).alias("bm25"))


def bm25(chunks: DataFrame, query: DataFrame) -> DataFrame:
    """task_id, chunk_id, score: sum of BM25 over each task's distinct terms; `query` is (task_id, term).
    Sums are rounded, as their last digits depend on the order of rows and would break ties."""
    wanted = query.select("task_id", "term").distinct()
    return wanted.join(term_scores(chunks, wanted), "term").groupBy("task_id", "chunk_id").agg(F.round(F.sum("bm25"), 10).alias("score"))


def symbol_keys(chunks: DataFrame) -> DataFrame:
    """key, chunk_id: exact lookup keys of named chunks."""
    return chunks.where("name <> ''").select(F.explode(T.exact_keys("name")).alias("key"), F.col("id").alias("chunk_id"))


def symbol_words(chunks: DataFrame) -> DataFrame:
    """word, chunk_id: distinct stemmed words of whole names."""
    return chunks.where("name <> ''").select(F.explode(F.array_distinct(T.stemmed_words("name"))).alias("word"), F.col("id").alias("chunk_id"))


def files_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("file").distinct()


def stripped(file: str = "file") -> Column:
    """A path without its extension."""
    dot = F.length(T.extension_of(file))
    return F.col(file).substr(F.lit(1), F.length(file) - dot)


def path_words(files: DataFrame) -> DataFrame:
    """word, file: distinct stemmed words of a path without extension."""
    return files.select(F.explode(F.array_distinct(T.stemmed_words(stripped()))).alias("word"), "file")


def basenames(files: DataFrame) -> DataFrame:
    """key, file: lower-case base name, with and without extension."""
    base = F.lower(T.base_name("file"))
    return files.select(F.explode(F.array_distinct(F.array(base, F.lower(T.base_name(stripped()))))).alias("key"), "file")


def path_suffixes(files: DataFrame) -> DataFrame:
    """suffix, file: the path and each tail of it after a slash, so that suffix matching is an equality join."""
    parts = F.split("file", "/")
    return files.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))).alias("suffix"), "file")
