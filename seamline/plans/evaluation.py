"""The evaluation of a corpus: labelled tasks, selections of several modes, metrics, summary and report.

All tasks of a corpus are in one plan. Modes: `lexical` (BM25, ten best), `deterministic` (the engine
without a judge), `judged` (with one).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.config import RetrievalConfig
from seamline.functions import text as T
from seamline.functions.terms import parse_tasks
from seamline.lineage import cut
from seamline.operators import evaluate as E
from seamline.operators import score
from seamline.operators.judge import Judge
from seamline.plans import engine

ROLES = ("required", "useful", "irrelevant")


@dataclass
class Evaluation:
    """Rows a task and mode, and what follows from them."""

    rows: DataFrame
    aggregates: DataFrame
    impact: DataFrame
    findings: DataFrame
    gates: DataFrame


def labelled_units(tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """task_id, role, unit, file, start_line, end_line, n of the labels of tasks (task_id and an array of
    labels a role); n is the number of chunks a label stands for, 1 where it is good."""
    said = [tasks.select("task_id", F.lit(r).alias("role"), F.explode(r).alias("label")) for r in ROLES]
    every = said[0].unionByName(said[1]).unionByName(said[2])
    return every.join(E.resolve_labels(every.select("label"), chunks), "label").withColumnRenamed("label", "unit")


def line_weights(sources: DataFrame) -> DataFrame:
    """file, line, chars of sources (path, source): UTF-16 units, with the newline that ends a line."""
    parts = sources.select(F.col("path").alias("file"), F.split("source", "\n", -1).alias("parts"))
    each = parts.select("file", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "text"))
    return each.select("file", (F.col("i") + 1).alias("line"), (T.utf16_length("text") + F.when(F.col("i") < F.col("n") - 1, 1).otherwise(0)).alias("chars"))


def score_selections(selected: DataFrame, tasks: DataFrame, units: DataFrame, weights: DataFrame, modes: list[str]) -> DataFrame:
    """mode, task_id, split, chunks, hit, total, recall, precision, the shares of the selected characters,
    size_reduction, missed and selected of every task (task_id, split) in every mode. `selected` holds
    mode, task_id, file, start_line, end_line; a task without selected chunks has no precision."""
    keys = ["mode", "task_id"]
    every = tasks.select("task_id", "split").join(F.broadcast(tasks.sparkSession.createDataFrame([(m,) for m in modes], "mode string")))
    wanted = every.select(*keys).join(units, "task_id")
    covered = cut(E.covered_units(wanted.where("role = 'required'").select(*keys, "unit", "file", "start_line", "end_line"), selected, keys))
    recall = E.recall(covered, keys)
    missed = covered.where("not covered").groupBy(*keys).agg(F.array_sort(F.collect_list("unit")).alias("missed"))
    good = wanted.where("role <> 'irrelevant'")
    place = F.array_sort(F.collect_list(F.struct("file", "start_line", "end_line"))).alias("selected")
    chosen = selected.groupBy(*keys).agg(F.count("*").alias("chunks"), place)
    matched = E.matched_chunks(selected, good, keys).groupBy(*keys).agg(F.count("*").alias("matched"))
    lines = E.lines_of(selected, [*keys, "file"]).join(weights, ["file", "line"], "left").withColumn("chars", F.coalesce("chars", F.lit(0)))

    def inside(of: DataFrame, name: str) -> DataFrame:
        return E.lines_of(of, [*keys, "file"]).withColumn(name, F.lit(True))

    marked = lines.join(inside(good, "is_wanted"), [*keys, "file", "line"], "left").join(inside(wanted.where("role = 'irrelevant'"), "is_irrelevant"), [*keys, "file", "line"], "left").na.fill(False)
    shares = E.character_shares(marked, keys).withColumn("selected_chars", F.col("wanted") + F.col("irrelevant") + F.col("unlabeled"))
    eligible = F.broadcast(weights.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("eligible")))
    out = every
    for part in (recall, missed, chosen, matched, shares):
        out = out.join(part, keys, "left")
    out = out.join(eligible).na.fill(0, ["hit", "total", "chunks", "matched", "irrelevant", "unlabeled", "selected_chars"])
    none = F.array()
    return out.select(
        *keys,
        "split",
        "chunks",
        "selected_chars",
        "hit",
        "total",
        "recall",
        E.ratio(F.col("matched"), F.col("chunks")).alias("precision"),
        E.ratio(F.col("irrelevant"), F.col("selected_chars")).alias("irrelevant_rate"),
        E.ratio(F.col("unlabeled"), F.col("selected_chars")).alias("unlabeled_share"),
        E.size_reduction(F.col("selected_chars"), F.col("eligible")).alias("size_reduction"),
        F.coalesce("missed", none.cast("array<string>")).alias("missed"),
        F.coalesce("selected", none.cast("array<struct<file:string,start_line:int,end_line:int>>")).alias("selected"),
    )


def summarize(rows: DataFrame) -> Evaluation:
    """Aggregates, impact of judging, findings and gates of score_selections() rows."""
    metrics = ["recall", "precision", "selected_chars"]
    pairs = E.paired_difference(rows, metrics, "judged", "deterministic").join(rows.select("task_id", "split").distinct(), "task_id")
    aggregates = cut(E.aggregate_modes(rows))
    return Evaluation(rows, aggregates, E.impact(pairs), E.findings(rows), E.check_gates(aggregates))


def evaluate(tasks: DataFrame, chunks: DataFrame, sources: DataFrame, judge: Judge | None = None, config: RetrievalConfig | None = None) -> Evaluation:
    """Runs and scores all modes over one corpus: tasks (task_id, split, task, and an array of labels a
    role), chunks, and sources (path, source) of the eligible files. Without a judge there is no
    judged mode. A label that stands for no chunk, or for several, is an error."""
    chunks, units = cut(chunks), cut(labelled_units(tasks, chunks))
    if bad := [r.unit for r in units.where("n <> 1").select("unit").distinct().collect()]:
        raise ValueError(f"labels that stand for no chunk or several: {', '.join(sorted(bad))}")
    place = chunks.select(F.col("id").alias("chunk_id"), "file", "start_line", "end_line")

    def of(mode: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(mode).alias("mode"), "task_id", "chunk_id").join(place, "chunk_id")

    selected = of("lexical", score.lexical_baseline(cut(parse_tasks(tasks)), chunks)).unionByName(of("deterministic", engine.run(tasks, chunks, config).selected))
    modes = ["lexical", "deterministic"]
    if judge is not None:
        selected, modes = selected.unionByName(of("judged", engine.run(tasks, chunks, config, judge).selected)), [*modes, "judged"]
    return summarize(cut(score_selections(cut(selected), tasks, units, cut(line_weights(sources)), modes)))


def _shown(value: object) -> str:
    return "n/a" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)


def report(found: Evaluation) -> str:
    """The summary tables as Markdown; their sizes are those of modes and splits, and the tasks' findings."""
    out = ["# Evaluation"]
    for title, table, order in (("Aggregates", found.aggregates, ["mode", "split"]), ("Impact of judging", found.impact, ["split"]), ("Findings", found.findings, ["task_id"]), ("Gates", found.gates, ["mode", "metric", "split"])):
        rows = table.orderBy(*order).collect()
        out += ["", f"## {title}", "", f"| {' | '.join(table.columns)} |", f"| {' | '.join('---' for _ in table.columns)} |"]
        out += [f"| {' | '.join(_shown(v) for v in r)} |" for r in rows]
    return "\n".join(out) + "\n"
