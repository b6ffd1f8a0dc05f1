"""Command line: python -m seamline.cli "<task>" --repo DIR."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from seamline.config import ConfigError, RetrievalConfig
from seamline.operators.judge import JudgeError, ReplayJudge
from seamline.operators.render import FORMATS, documents, render, write_atomically
from seamline.operators.split import warning_summary
from seamline.plans import engine
from seamline.sources.scan import UsageError

#: Exit codes by error.
EXIT = {UsageError: 2, ConfigError: 2, JudgeError: 3}


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="seamline", description="Smallest useful regions of a code base for a task.")
    p.add_argument("task")
    p.add_argument("--repo", default=".")
    p.add_argument("--format", choices=sorted(FORMATS), default="text")
    p.add_argument("--output")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--min-relevance", type=float, default=0.5)
    p.add_argument("--replay", help="recording of a judge's decisions; without one every candidate scores 1")
    args = p.parse_args(argv)
    if not args.task.strip():
        p.error("the task must not be empty")
    if not 0 <= args.min_relevance <= 1:
        p.error("--min-relevance must be in [0, 1]")
    return args


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        chunks, warned, scan = engine.load_chunks(spark, args.repo)
        tasks = spark.createDataFrame([("0", args.task)], "task_id string, task string")
        judge = ReplayJudge.read(args.replay) if args.replay else None
        result = engine.run(tasks, chunks, judge_=judge, min_relevance=args.min_relevance)
        doc = documents(result, "judged" if judge else "offline", RetrievalConfig().version, args.explain, scan.warnings, {r.kind: r.files for r in warning_summary(warned).collect()})[0]
        text = render(args.format, doc)
        if args.output:
            write_atomically(args.output, text, {f"{engine.scans.resolve_root(args.repo)}/{f}" for f in scan.files})
        else:
            sys.stdout.write(text)
    except tuple(EXIT) as error:
        print(error, file=sys.stderr)
        return EXIT[type(error)]
    return 0


if __name__ == "__main__":
    sys.exit(main())
