"""Splitters: a source file to line-exact chunks, by language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from seamline.operators.split import data, ecmascript, markdown, markup, python_source, sql, style
from seamline.operators.split.base import MAX_REASON, Analysis, collapse, text_fallback
from seamline.schemas import CHUNK

ANALYZERS: dict[str, Callable[[str, str, str], Analysis]] = {
    **dict.fromkeys(("typescript", "javascript"), ecmascript.split_ecmascript),
    "python": python_source.split_python,
    "markdown": markdown.split_markdown,
    **dict.fromkeys(("json", "yaml", "toml"), data.split_data),
    "sql": sql.split_sql,
    "html": markup.split_markup,
    **dict.fromkeys(("css", "scss"), style.split_style),
}
WARNING_SCHEMA = "file string, kind string, message string"


def analyze_file(file: str, source: str, language: str, analyzers: dict | None = None) -> Analysis:
    """Chunks of a file, whatever happens: text windows stand in where there is no splitter, where it
    fails or finds nothing, and over the lines that a file with syntax errors leaves uncovered."""
    if "\0" in source:
        return Analysis(warnings=[f"{file}: binary content (NUL byte); skipped"])
    split = (ANALYZERS if analyzers is None else analyzers).get(language)
    if split is None:
        out = text_fallback(file, source, language, f'no analyzer for language "{language}"')
        out.text_only = bool(out.chunks)
        return out
    try:
        found = split(file, source, language)
    except Exception as error:  # any splitter may fail on any input; the file is still read
        return text_fallback(file, source, language, f"analyzer failed ({collapse(str(error))[:MAX_REASON]})")
    if found.chunks and not found.partial:
        return found
    rest = text_fallback(file, source, language, "syntax errors" if found.partial else "analyzer extracted no chunks", [(c["start_line"], c["end_line"]) for c in found.chunks])
    chunks = sorted([*found.chunks, *rest.chunks], key=lambda c: (c["start_line"], c["end_line"]))
    return Analysis(chunks, [*found.warnings, *rest.warnings], found.partial)


def split_files(files: DataFrame) -> DataFrame:
    """CHUNK rows of (path, source, language) rows. Each file is split by itself, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [c for p, s, g in zip(pdf["path"], pdf["source"], pdf["language"], strict=True) if s is not None for c in analyze_file(p, s, g).chunks]
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in CHUNK.split(", ")[:10]] + ["references"])

    return files.select("path", "source", "language").mapInPandas(run, CHUNK)


#: (part of a message, kind): the first that fits.
WARNING_KINDS = [("syntax errors", "syntax-error"), ("binary content", "binary"), ("no analyzer", "plain-text"), ("analyzer failed", "analyzer-failed"), ("extracted no chunks", "no-chunks"), ("contains comments", "jsonc"), ("unterminated", "unterminated")]
LISTED = frozenset(["syntax-error"])


def warning_kind(message: str) -> str:
    return next((kind for part, kind in WARNING_KINDS if part in message), "other")


def file_warnings(files: DataFrame) -> DataFrame:
    """file, kind, message of what splitters report."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, warning_kind(m), m) for p, s, g in zip(pdf["path"], pdf["source"], pdf["language"], strict=True) if s is not None for m in analyze_file(p, s, g).warnings]
            yield pd.DataFrame(rows, columns=["file", "kind", "message"])

    return files.select("path", "source", "language").mapInPandas(run, WARNING_SCHEMA)


def warning_summary(warnings: DataFrame) -> DataFrame:
    """kind, files: distinct files with each kind of warning, most first."""
    from pyspark.sql import functions as F

    return warnings.groupBy("kind").agg(F.count_distinct("file").alias("files")).orderBy(F.col("files").desc(), "kind")


def text_only_summary(paths: list[str], detailed: bool = False) -> str | None:
    """One line for all files that were read as plain windows."""
    if not paths:
        return None
    shown = paths[: 20 if detailed else 3]
    more = f", and {len(paths) - len(shown)} more" if len(paths) > len(shown) else ""
    return f"{len(paths)} file(s) have no analyzer and were read as plain text windows ({'' if detailed else 'for example '}{', '.join(shown)}{more})"
