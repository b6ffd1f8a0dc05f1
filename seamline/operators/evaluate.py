"""Coverage of labelled code by selections, recall, precision, shares, aggregates and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
# Floors that a release must pass, (tuning, heldout).
GATES = {
    ("judged", "recall"): (0.85, 0.70),
    ("judged", "precision"): (0.55, 0.45),
    ("judged", "size_reduction"): (0.80, 0.80),
    ("deterministic", "recall"): (0.95, 0.75),
}
THRESHOLDS = [round(0.30 + 0.05 * i, 2) for i in range(11)]


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to divide by."""
    return F.when(whole != 0, part.cast("double") / whole)


def lines_of(ranges: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """keys, line: each line of the ranges once."""
    return ranges.where(F.col(start) <= F.col(end)).select(*keys, F.explode(F.sequence(start, end)).alias("line")).distinct()


def covered_units(units: DataFrame, selected: DataFrame, keys: list[str], share: float = COVERAGE) -> DataFrame:
    """Units (keys, unit, file, start_line, end_line) with `covered`: whether the lines of `selected`
    (keys, file, start_line, end_line) hold at least the share of theirs."""
    own = lines_of(units, [*keys, "unit", "file"])
    hit = lines_of(selected, [*keys, "file"]).withColumn("hit", F.lit(1))
    counts = own.join(hit, [*keys, "file", "line"], "left").groupBy(*keys, "unit").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return units.join(counts, [*keys, "unit"], "left").withColumn("covered", F.coalesce(F.col("hits") >= share * F.col("n"), F.lit(False))).drop("n", "hits")


def overlap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]) + 1)


def covers(chunk: tuple[Column, Column], unit: tuple[Column, Column], share: float = COVERAGE) -> Column:
    """Whether two ranges of a file overlap by the share of either one."""
    both = overlap(chunk, unit)
    return (both > 0) & ((both >= share * (unit[1] - unit[0] + 1)) | (both >= share * (chunk[1] - chunk[0] + 1)))


def matched_chunks(selected: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Selected chunks that match a unit; an equality join on the file with a range condition."""
    s, u = selected.alias("s"), units.alias("u")
    on = [F.col(f"s.{k}") == F.col(f"u.{k}") for k in [*keys, "file"]]
    cond = covers((F.col("s.start_line"), F.col("s.end_line")), (F.col("u.start_line"), F.col("u.end_line")))
    for c in on:
        cond = cond & c
    return s.join(u, cond, "left_semi")


def recall(units: DataFrame, keys: list[str], covered: str = "covered") -> DataFrame:
    """keys, hit, total, recall of required units."""
    counts = units.groupBy(*keys).agg(F.sum(F.col(covered).cast("long")).alias("hit"), F.count("*").alias("total"))
    return counts.withColumn("recall", ratio(F.col("hit"), F.col("total")))


def precision(selected: DataFrame, keys: list[str], matched: str = "matched") -> DataFrame:
    counts = selected.groupBy(*keys).agg(F.sum(F.col(matched).cast("long")).alias("hit"), F.count("*").alias("total"))
    return counts.withColumn("precision", ratio(F.col("hit"), F.col("total")))


def character_shares(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, wanted, irrelevant, unlabeled characters of selected lines (keys, line, chars, is_wanted,
    is_irrelevant); a line counts once, wanted before irrelevant."""
    label = F.when(F.col("is_wanted"), "wanted").when(F.col("is_irrelevant"), "irrelevant").otherwise("unlabeled")
    return lines.groupBy(*keys).agg(*(F.sum(F.when(label == k, F.col("chars")).otherwise(0)).alias(k) for k in ("wanted", "irrelevant", "unlabeled")))


def size_reduction(selected: Column, eligible: Column) -> Column:
    return F.when(eligible != 0, 1 - selected.cast("double") / eligible)


def aggregate_modes(rows: DataFrame) -> DataFrame:
    """mode, split, macro and micro metrics of task rows (mode, split, recall, hit, total, precision,
    size_reduction): every split, and "all" where a mode has more than one."""
    sets = rows.groupingSets([["mode", "split"], ["mode"]], "mode", "split").agg(
        F.grouping("split").alias("whole"),
        F.count_distinct("split").alias("splits"),
        F.count("*").alias("tasks"),
        F.avg("recall").alias("recall_macro"),
        ratio(F.sum("hit"), F.sum("total")).alias("recall_micro"),
        F.avg("precision").alias("precision_macro"),
        F.avg("size_reduction").alias("size_reduction_macro"),
    )
    return sets.where("whole = 0 or splits > 1").select("mode", F.when(F.col("whole") == 1, "all").otherwise(F.col("split")).alias("split"), "tasks", "recall_macro", "recall_micro", "precision_macro", "size_reduction_macro")


def paired_difference(rows: DataFrame, metrics: list[str], one: str, other: str) -> DataFrame:
    """task_id and one minus other for each metric; null where either is."""
    a = rows.where(F.col("mode") == one).select("task_id", *(F.col(m).alias(f"a_{m}") for m in metrics))
    b = rows.where(F.col("mode") == other).select("task_id", *(F.col(m).alias(f"b_{m}") for m in metrics))
    return a.join(b, "task_id").select("task_id", *((F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in metrics))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, min, mean, max of the defined values."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def findings(rows: DataFrame) -> DataFrame:
    """task_id, finding from the judged and the deterministic result of each task (task_id, mode, recall,
    precision, selected): `regression` where recall fell, else `identical` where both selected the same,
    else `no-gain` where neither recall nor precision rose; other tasks have no finding."""
    side = lambda mode, p: rows.where(F.col("mode") == mode).select("task_id", *(F.col(c).alias(f"{p}_{c}") for c in ("recall", "precision", "selected")))
    both = side("judged", "a").join(side("deterministic", "b"), "task_id")
    not_up = lambda c: F.coalesce(F.col(f"a_{c}"), F.lit(0.0)) <= F.coalesce(F.col(f"b_{c}"), F.lit(0.0))
    kind = F.when(F.col("a_recall") < F.col("b_recall"), "regression").when(F.to_json("a_selected") == F.to_json("b_selected"), "identical").when(not_up("recall") & not_up("precision"), "no-gain")
    return both.select("task_id", kind.alias("finding")).where("finding IS NOT NULL")


def threshold_sweep(rows: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """split, threshold, selected, required, recall, precision of scored rows (split, score, required)
    at each threshold; recall is 1 where nothing is required."""
    steps = F.explode(F.array(*(F.lit(t) for t in thresholds or THRESHOLDS))).alias("threshold")
    swept = rows.select("split", "score", "required", steps).withColumn("on", F.col("score") >= F.col("threshold"))
    counts = swept.groupBy("split", "threshold").agg(F.sum(F.col("on").cast("long")).alias("selected"), F.sum((F.col("on") & F.col("required")).cast("long")).alias("hit"), F.sum(F.col("required").cast("long")).alias("required"))
    return counts.select("split", "threshold", "selected", "required", F.coalesce(ratio(F.col("hit"), F.col("required")), F.lit(1.0)).alias("recall"), ratio(F.col("hit"), F.col("selected")).alias("precision"))


def check_gates(aggregates: DataFrame) -> DataFrame:
    """mode, metric, split, value, floor, passed for aggregate_modes() rows: pooled recall, mean precision
    and mean size reduction against their floors, and judged precision above deterministic. A missing
    value fails."""
    spark = aggregates.sparkSession
    floors = spark.createDataFrame([(m, k, s, f) for (m, k), fs in GATES.items() for s, f in zip(("tuning", "heldout"), fs, strict=True)], "mode string, metric string, split string, floor double")
    named = aggregates.select("mode", "split", F.col("recall_micro").alias("recall"), F.col("precision_macro").alias("precision"), F.col("size_reduction_macro").alias("size_reduction"))
    values = named.unpivot(["mode", "split"], ["recall", "precision", "size_reduction"], "metric", "value")
    fixed = floors.join(values, ["mode", "metric", "split"], "left").select("mode", "metric", "split", "value", "floor", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)).alias("passed"))
    side = lambda mode, name: named.where(F.col("mode") == mode).select("split", F.col("precision").alias(name))
    splits = spark.createDataFrame([("tuning",), ("heldout",)], "split string")
    above = splits.join(side("judged", "value"), "split", "left").join(side("deterministic", "floor"), "split", "left")
    return fixed.unionByName(above.select(F.lit("judged").alias("mode"), F.lit("precision over deterministic").alias("metric"), "split", "value", "floor", F.coalesce(F.col("value") > F.col("floor"), F.lit(False)).alias("passed")))


def impact(rows: DataFrame) -> DataFrame:
    """split, tasks, mean recall, precision and selected_chars of the paired differences (task_id, split, and
    these), and on how many tasks recall rose, stayed and fell; `all` where there is more than one split."""
    sets = rows.groupingSets([["split"], []], "split").agg(
        F.grouping("split").alias("whole"),
        F.count_distinct("split").alias("splits"),
        F.count("*").alias("tasks"),
        *(F.avg(c).alias(c) for c in ("recall", "precision", "selected_chars")),
        *(F.count_if(cond).alias(name) for name, cond in (("better", F.col("recall") > 0), ("same", F.col("recall") == 0), ("worse", F.col("recall") < 0))),
    )
    return sets.where("whole = 0 or splits > 1").select(F.when(F.col("whole") == 1, "all").otherwise(F.col("split")).alias("split"), "tasks", "recall", "precision", "selected_chars", "better", "same", "worse")


def candidate_recall(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """task_id, found, total: required units (task_id, unit, chunk_id: any chunk the label stands for) of which
    some chunk is among the candidates (task_id, chunk_id)."""
    hit = candidates.select("task_id", "chunk_id").distinct().withColumn("hit", F.lit(1))
    each = units.join(hit, ["task_id", "chunk_id"], "left").groupBy("task_id", "unit").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return each.groupBy("task_id").agg(F.sum("hit").alias("found"), F.count("*").alias("total"))


def resolve_labels(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """label, n, file, start_line, end_line: `path::name`, `path::name@start-end`, or a bare path whose
    file is one chunk; a label is good where n is 1."""
    parts = labels.select("label").distinct().select("label", F.split_part("label", F.lit("::"), F.lit(1)).alias("file"), F.split_part("label", F.lit("::"), F.lit(2)).alias("rest"))
    named = parts.select("label", "file", F.regexp_replace("rest", r"@\d+-\d+$", "").alias("symbol"), F.regexp_extract("rest", r"@(\d+)-(\d+)$", 1).alias("s"), F.regexp_extract("rest", r"@(\d+)-(\d+)$", 2).alias("e"))
    own = chunks.select("file", "name", "kind", "start_line", "end_line")
    hit = named.join(own, "file", "left").where(F.when(F.col("symbol") == "", F.col("kind") == "file").otherwise(F.col("name") == F.col("symbol")) & ((F.col("s") == "") | ((F.col("s").try_cast("int") == F.col("start_line")) & (F.col("e").try_cast("int") == F.col("end_line")))))
    got = hit.groupBy("label").agg(F.count("*").alias("n"), F.min("file").alias("file"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return labels.select("label").distinct().join(got, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
