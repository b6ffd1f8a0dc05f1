import pytest

from seamline.operators import evaluate as E
from seamline.operators.split import split_files
from seamline.plans import evaluation

FILES = {
    "src/invoice.ts": "export function totalDue(a: number) {\n  return a;\n}\nexport function sendReminder() {\n  return 1;\n}\n",
    "src/user.ts": "export function loadUser() {\n  return 2;\n}\n",
    "src/mail.ts": 'import { sendReminder } from "./invoice";\nexport function sendMail() {\n  return sendReminder();\n}\n',
}


def tables(spark):
    files = spark.createDataFrame([(p, s, "typescript") for p, s in FILES.items()], "path string, source string, language string")
    tasks = spark.createDataFrame(
        [("t1", "tuning", "send the reminder", ["src/invoice.ts::sendReminder"], ["src/mail.ts::sendMail"], ["src/user.ts::loadUser"]), ("t2", "heldout", "load a user", ["src/user.ts::loadUser", "src/invoice.ts::totalDue"], [], [])],
        "task_id string, split string, task string, required array<string>, useful array<string>, irrelevant array<string>",
    )
    return tasks, split_files(files), files


def test_metrics_by_hand(spark):
    tasks, chunks, files = tables(spark)
    units = evaluation.labelled_units(tasks, chunks)
    assert {r.n for r in units.collect()} == {1}
    weights = evaluation.line_weights(files)
    sizes = {f: len(s) for f, s in FILES.items()}
    assert {r.file: r["sum(chars)"] for r in weights.groupBy("file").sum("chars").collect()} == sizes
    at = {(c.file, c.name): (c.start_line, c.end_line) for c in chunks.collect()}
    pick = [("judged", "t1", "src/invoice.ts", "sendReminder"), ("judged", "t1", "src/user.ts", "loadUser"), ("deterministic", "t1", "src/invoice.ts", "totalDue"), ("deterministic", "t2", "src/user.ts", "loadUser")]
    selected = spark.createDataFrame([(m, t, f, *at[f, n]) for m, t, f, n in pick], "mode string, task_id string, file string, start_line int, end_line int")
    got = {(r.mode, r.task_id): r for r in evaluation.score_selections(selected, tasks, units, weights, ["judged", "deterministic"]).collect()}
    r = got["judged", "t1"]
    of = lambda f, n: sum(len(x) + 1 for x in FILES[f].split("\n")[at[f, n][0] - 1 : at[f, n][1]])
    chars = of("src/invoice.ts", "sendReminder") + of("src/user.ts", "loadUser")
    assert (r.chunks, r.hit, r.total, r.recall, r.precision, r.selected_chars) == (2, 1, 1, 1.0, 0.5, chars)
    assert r.irrelevant_rate == pytest.approx(of("src/user.ts", "loadUser") / chars) and r.unlabeled_share == 0.0
    assert r.size_reduction == pytest.approx(1 - chars / sum(sizes.values()))
    assert (got["deterministic", "t1"].recall, got["deterministic", "t1"].missed) == (0.0, ["src/invoice.ts::sendReminder"])
    none = got["judged", "t2"]
    assert (none.chunks, none.recall, none.precision, none.irrelevant_rate, none.size_reduction, none.selected) == (0, 0.0, None, None, 1.0, [])


def test_findings_impact_and_gates(spark):
    rows = spark.createDataFrame(
        [(m, t, s, recall, precision, 10 * k, 1, 2, 0.9, [f"{m}{t}" if t != "b" else "x"]) for k, (m, t, s, recall, precision) in enumerate([("judged", "a", "tuning", 0.5, 0.9), ("deterministic", "a", "tuning", 1.0, 0.1), ("judged", "b", "tuning", 1.0, 0.5), ("deterministic", "b", "tuning", 1.0, 0.5), ("judged", "c", "heldout", 1.0, 0.2), ("deterministic", "c", "heldout", 1.0, 0.3), ("judged", "d", "heldout", None, 0.6), ("deterministic", "d", "heldout", None, 0.3)])],
        "mode string, task_id string, split string, recall double, precision double, selected_chars long, hit long, total long, size_reduction double, selected array<string>",
    )
    found = evaluation.summarize(rows)
    assert {r.task_id: r.finding for r in found.findings.collect()} == {"a": "regression", "b": "identical", "c": "no-gain"}
    impact = {r.split: r for r in found.impact.collect()}
    assert [(impact[s].tasks, impact[s].better, impact[s].same, impact[s].worse) for s in ("tuning", "heldout", "all")] == [(2, 0, 1, 1), (2, 0, 1, 0), (4, 0, 2, 1)]
    gates = {(r.mode, r.metric, r.split): (r.value, r.floor, r.passed) for r in found.gates.collect()}
    assert len(gates) == 10
    assert gates["judged", "precision", "tuning"] == (pytest.approx(0.7), 0.55, True)
    assert gates["judged", "recall", "tuning"] == (0.5, 0.85, False)
    assert gates["judged", "precision over deterministic", "heldout"] == (pytest.approx(0.4), pytest.approx(0.3), True)
    missing = E.check_gates(found.aggregates.where("mode = 'judged'"))
    assert not any(r.passed for r in missing.where("mode = 'deterministic' or metric = 'precision over deterministic'").collect())


def test_a_whole_evaluation(spark):
    tasks, chunks, files = tables(spark)
    found = evaluation.evaluate(tasks, chunks, files)
    rows = {(r.mode, r.task_id): r for r in found.rows.collect()}
    assert set(rows) == {(m, t) for m in ("lexical", "deterministic") for t in ("t1", "t2")}
    assert rows["deterministic", "t1"].recall == 1.0 and rows["lexical", "t1"].recall == 1.0
    said = evaluation.report(found)
    assert "| deterministic | tuning | 1 | 1.000 |" in said and "## Gates" in said
    with pytest.raises(ValueError, match="nothing"):
        evaluation.evaluate(tasks.selectExpr("task_id", "split", "task", "array('src/user.ts::nothing') AS required", "useful", "irrelevant"), chunks, files)


def test_candidate_recall(spark):
    units = spark.createDataFrame([("t", "u", "a"), ("t", "u", "b"), ("t", "v", "c")], "task_id string, unit string, chunk_id string")
    assert [tuple(r) for r in E.candidate_recall(units, spark.createDataFrame([("t", "b"), ("t", "x")], "task_id string, chunk_id string")).collect()] == [("t", 1, 2)]
