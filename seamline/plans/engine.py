"""The engine: tasks and chunks in, ranked regions out, all tasks in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.config import MIN_RELEVANCE, SIGNALS, RetrievalConfig
from seamline.functions.terms import parse_tasks
from seamline.lineage import cut
from seamline.operators import graph, judge, rank, score, select
from seamline.operators.split import file_warnings, split_files
from seamline.sources import files as source_files
from seamline.sources import scan as scans


@dataclass
class Result:
    """Tables of a run: candidates (judged), selected, skipped, regions, warnings."""

    terms: DataFrame
    chunks: DataFrame
    candidates: DataFrame
    selected: DataFrame
    skipped: DataFrame
    regions: DataFrame
    warnings: DataFrame


def load_chunks(spark: SparkSession, root: str, limits: scans.Limits | None = None) -> tuple[DataFrame, DataFrame, scans.Scan]:
    """(chunks, file warnings, scan) of a directory."""
    top = scans.resolve_root(root)
    scan = scans.scan_repository(top, limits)
    sources = source_files.source_files(source_files.read_files(spark, top, scan.files))
    return split_files(sources), file_warnings(sources), scan


def chunk_table(files: DataFrame) -> DataFrame:
    """Chunks of a table of (path, content binary), for corpora that are tables already."""
    return split_files(source_files.source_files(files))


def generate_candidates(terms: DataFrame, chunks: DataFrame, config: RetrievalConfig, double_stem: bool = True) -> DataFrame:
    """Every candidate of every task, ranked signals and total, without repeated ranges."""
    scores = cut(score.score_chunks(terms, chunks, config, double_stem))
    edges = cut(graph.build_edges(chunks))
    return rank.dedupe_by_rank(rank.rank_candidates(terms, scores, edges, chunks, config))


def decide(best: DataFrame, chunks: DataFrame, terms: DataFrame, judge_: judge.Judge) -> DataFrame:
    """Judgments (task_id, chunk_id, relevance) of the shortlists. At most shortlist_size rows a task
    come to the driver, one task at a time, as a judge is a caller's object."""
    spark = best.sparkSession
    tasks = {r.task_id: r.task for r in terms.select("task_id", "task").collect()}
    rows = best.select("task_id", "chunk_id", "rank").join(chunks.select(F.col("id").alias("chunk_id"), "file", "language", "kind", "name", "start_line", "end_line", "content"), "chunk_id").orderBy("task_id", "rank")
    out, now, batch = [], None, []

    def flush() -> None:
        if batch:
            decision = judge_.decide(tasks[now], batch)
            out.extend((now, i, r) for i, r in judge.validate_relevance([c.id for c in batch], decision.judgments).items())

    for r in rows.toLocalIterator():
        if r.task_id != now:
            flush()
            now, batch = r.task_id, []
        batch.append(judge.Candidate(r.chunk_id, r.file, r.language, r.kind, r.name, r.start_line, r.end_line, r.content))
    flush()
    return spark.createDataFrame(out, "task_id string, chunk_id string, relevance double")


def run(tasks: DataFrame, chunks: DataFrame, config: RetrievalConfig | None = None, judge_: judge.Judge | None = None, min_relevance: float = MIN_RELEVANCE, double_stem: bool = True) -> Result:
    """Retrieval, judging, selection and regions for (task_id, task) rows. Without a judge every
    candidate scores 1, in the plan; no row reaches the driver."""
    config = config or RetrievalConfig()
    chunks, terms = cut(chunks), cut(parse_tasks(tasks))
    best = rank.shortlist(generate_candidates(terms, chunks, config, double_stem), chunks, terms, config)
    best = cut(best)
    if judge_ is None:
        judged = best.withColumns({"relevance": F.lit(None).cast("double"), "score": F.lit(1.0)})
    else:
        given = decide(best, chunks, terms, judge_)
        judged = best.join(given, ["task_id", "chunk_id"]).withColumn("score", F.col("relevance"))
    selected, skipped = select.select_by_relevance(judged, chunks, min_relevance)
    selected = cut(selected.withColumn("reason", F.coalesce("reason", F.lit("Offline baseline" if judge_ is None else "Judged relevant"))))
    regions = select.region_relevance(select.merge_regions(selected, chunks), judged)
    return Result(terms, chunks, judged, selected, skipped, regions, rank.shortlist_warnings(best, terms, config))


def explained(result: Result) -> DataFrame:
    """Selected chunks with signals, origin, reason: the evidence of a selection."""
    return result.selected.join(result.candidates.select("task_id", "chunk_id", "origin", "total", *SIGNALS, "relevance"), ["task_id", "chunk_id"], "left")
