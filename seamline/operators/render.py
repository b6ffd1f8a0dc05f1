"""Results as text, Markdown and JSON, and their file sink."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import dataclass, field

from seamline.config import SCHEMA_VERSION, SIGNALS

CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029]")


@dataclass
class Item:
    """A selected or skipped chunk."""

    id: str
    file: str
    kind: str
    start_line: int
    end_line: int
    name: str | None = None
    relevance: float | None = None
    score: float = 0.0
    reason: str | None = None
    support_for: list[str] | None = None
    signals: dict[str, float] = field(default_factory=dict)
    origin: str | None = None


@dataclass
class Block:
    """A region with its members."""

    file: str
    language: str
    start_line: int
    end_line: int
    content: str
    items: list[Item]

    @property
    def relevance(self) -> float | None:
        return max((i.relevance for i in self.items if i.relevance is not None), default=None)

    @property
    def key(self) -> float:
        return self.relevance if self.relevance is not None else max((i.score for i in self.items), default=0.0)


@dataclass
class Document:
    mode: str
    task: str
    blocks: list[Block]
    skipped: list[Item] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    warning_summary: dict[str, int] = field(default_factory=dict)
    config_version: str | None = None
    question_version: str | None = None
    explain: bool = False


def plain(text: str) -> str:
    """Control characters as U+FFFD."""
    return CONTROL.sub("\ufffd", text)


def ticks(text: str) -> int:
    return max((len(r) for r in re.findall("`+", text)), default=0)


def span(text: str) -> str:
    clean = plain(text)
    mark = "`" * (ticks(clean) + 1)
    return f"{mark} {clean} {mark}"


def fenced(content: str, info: str = "") -> str:
    fence = "`" * max(3, ticks(content) + 1)
    return f"{fence}{info}\n{content}\n{fence}"


def value(item: Item) -> str:
    if item.relevance is None and item.support_for:
        return "supporting declaration"
    shown = item.score if item.relevance is None else item.relevance
    return f"{'score' if item.relevance is None else 'relevance'} {shown:.2f}"


def where(item: Item) -> str:
    return f"{item.file}:{item.start_line}-{item.end_line}" + (f" {item.name}" if item.name else "")


def ranked(doc: Document) -> list[Block]:
    return sorted(doc.blocks, key=lambda b: (-b.key, b.file, b.start_line))


def left_out(doc: Document) -> list[Item]:
    """Skipped items, most relevant first."""
    return sorted(doc.skipped, key=lambda i: (-(i.score if i.relevance is None else i.relevance), i.file, i.start_line, i.id))


def summary(doc: Document, quote) -> list[str]:
    lines = [f"Mode: {doc.mode}", f"Regions: {len(doc.blocks)}"]
    if doc.config_version:
        lines.append(f"Retrieval config: {quote(doc.config_version)}")
    if doc.question_version:
        lines.append(f"Judge questions: {quote(doc.question_version)}")
    return lines


def below(doc: Document, quote) -> list[str]:
    if not doc.skipped:
        return []
    if not doc.explain:
        return [f"{len(doc.skipped)} candidate(s) scored below the relevance minimum and are not listed."]
    return [f"{quote(where(i))} ({value(i)}): below the relevance minimum" for i in left_out(doc)]


def evidence(doc: Document, quote) -> list[tuple[str, list[str]]]:
    """(title, lines) of each selected chunk, by place."""
    known = {i.id: where(i) for i in [*doc.skipped, *(i for b in doc.blocks for i in b.items)]}
    label = lambda key: quote(known.get(key, f"chunk {key}"))
    out = []
    for item in sorted((i for b in doc.blocks for i in b.items), key=lambda i: (i.file, i.start_line, i.id)):
        source = "not recorded"
        if item.support_for:
            source = "supporting declaration for " + ", ".join(map(label, item.support_for))
        elif item.origin == "direct":
            source = "direct (dependency distance 0)"
        elif (item.origin or "").startswith("expanded-from:"):
            source = f"expanded from {label(item.origin.split(':', 1)[1])} (dependency distance 1)"
        signals = ", ".join(f"{k} {v:.2f}" for k, v in sorted(item.signals.items())) or "none"
        judged = "not judged" if item.relevance is None else f"{item.relevance:.2f}"
        out.append((quote(where(item)), [f"Signals: {signals}", f"Judged relevance: {judged}", f"Score: {item.score:.2f}", f"Origin: {source}", f"Reason: {quote(item.reason or 'none')}"]))
    return out


def render_text(doc: Document) -> str:
    parts = [f"Context for: {doc.task}\n", "\n".join(summary(doc, plain)) + "\n"]
    for b in ranked(doc):
        names = ", ".join(dict.fromkeys(i.name for i in b.items if i.name))
        values = value(b.items[0]) if len(b.items) == 1 else "; ".join(f"{i.name} {value(i)}" if i.name else value(i) for i in b.items)
        parts.append(f"== {b.file}:{b.start_line}-{b.end_line}{' ' + names if names else ''} ({values}) ==\n{b.content}\n")
    if doc.explain:
        parts.append("-- Explanation --\n" + "\n\n".join("\n".join([t, *(f"  {x}" for x in lines)]) for t, lines in evidence(doc, plain)) + "\n")
    lines = below(doc, plain)
    if lines:
        parts.append("-- Left out (below relevance minimum) --\n" + "\n".join(lines) + "\n" if doc.explain else lines[0] + "\n")
    return "\n".join(parts)


def render_markdown(doc: Document) -> str:
    out = ["# Context", "", "Task:", "", fenced(doc.task, "text"), "", *(f"- {x}" for x in summary(doc, span))]
    if doc.warnings or doc.warning_summary:
        counted = ", ".join(f"{n} {k}" for k, n in sorted(doc.warning_summary.items(), key=lambda e: (-e[1], e[0])))
        out += ["", "## Warnings", "", *(f"- {span(w)}" for w in doc.warnings), *([f"- Files with scan warnings: {counted}"] if counted else [])]
    for b in ranked(doc):
        out += ["", f"## {span(f'{b.file}:{b.start_line}-{b.end_line}')}", "", f"- Language: {b.language}"]
        out += [f"- {span(i.name) if i.name else '(unnamed)'}, {i.kind}, lines {i.start_line}-{i.end_line}: {value(i)}" for i in b.items]
        out += ["", fenced(b.content, b.language)]
    if doc.explain:
        out += ["", "## Explanation"]
        for title, lines in evidence(doc, span):
            out += ["", f"### {title}", "", *(f"- {x}" for x in lines)]
    if lines := below(doc, span):
        out += ["", "## Left out", "", *(f"- {x}" for x in lines)]
    return "\n".join(out) + "\n"


def _some(**values) -> dict:
    return {k: v for k, v in values.items() if v is not None}


def payload(doc: Document) -> dict:
    """The JSON form; keys in fixed order, optional ones absent."""
    item = lambda i: _some(id=i.id, name=i.name, kind=i.kind, startLine=i.start_line, endLine=i.end_line, relevance=i.relevance, supportFor=i.support_for) | (_some(score=i.score, reason=i.reason, signals=dict(sorted(i.signals.items())), origin=i.origin) if doc.explain else {})
    regions = [_some(file=b.file, language=b.language, startLine=b.start_line, endLine=b.end_line, relevance=b.relevance) | {"content": b.content, "chunks": [item(i) for i in b.items]} for b in ranked(doc)]
    out = {"schemaVersion": SCHEMA_VERSION, "mode": doc.mode, "task": doc.task, "regions": regions, "warnings": doc.warnings, "warningSummary": doc.warning_summary}
    if doc.explain:
        out["skipped"] = [_some(chunkId=i.id, file=i.file, startLine=i.start_line, endLine=i.end_line, name=i.name, relevance=i.relevance, score=i.score) for i in left_out(doc)]
    return out | _some(retrievalConfigVersion=doc.config_version, questionVersion=doc.question_version, explain=True if doc.explain else None)


def render_json(doc: Document) -> str:
    return json.dumps(payload(doc), indent=2, ensure_ascii=False) + "\n"


FORMATS = {"text": render_text, "markdown": render_markdown, "json": render_json}


def render(fmt: str, doc: Document) -> str:
    return FORMATS[fmt](doc)


def write_atomically(path: str, text: str, sources: set[str] = frozenset()) -> None:
    """Writes beside the target, then renames; a file that was a source is refused."""
    real = os.path.realpath(path)
    if real in sources:
        raise ValueError(f"refusing to overwrite a source file: {path}")
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(real) or ".", prefix=".out-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(temp, real)
    except BaseException:
        os.unlink(temp)
        raise


def write_new(path: str, text: str) -> str:
    """Writes a report under a name that does not exist yet, and returns it."""
    stem, ext = os.path.splitext(path)
    for n in range(1, 10_000):
        name = path if n == 1 else f"{stem}-{n}{ext}"
        try:
            with open(name, "x", encoding="utf-8") as f:
                f.write(text)
            return name
        except FileExistsError:
            continue
    raise FileExistsError(path)


def documents(result, mode: str, config_version: str | None = None, explain: bool = False, warnings: list[str] = (), warning_summary: dict[str, int] | None = None) -> list[Document]:
    """One document for each task of a run. Only what is shown comes to the driver: the regions and
    the at most shortlist_size candidates of a task."""
    facts = {(r.task_id, r.chunk_id): r for r in result.candidates.select("task_id", "chunk_id", "relevance", "score", "origin", *SIGNALS).collect()}
    shape = result.chunks.select("id", "file", "kind", "name", "start_line", "end_line")
    place = {r.id: r for r in shape.join(result.selected.selectExpr("chunk_id as id").union(result.skipped.selectExpr("chunk_id as id")).distinct(), "id").collect()}

    def item(task: str, key: str, score: float, reason: str | None = None, support: list[str] | None = None) -> Item:
        p, f = place[key], facts.get((task, key))
        signals = {s: f[s] for s in SIGNALS} if f and not support else {}
        return Item(key, p.file, p.kind, p.start_line, p.end_line, p.name, f.relevance if f and not support else None, score, reason, support, signals, f.origin if f and not support else None)

    chosen = {(r.task_id, r.chunk_id): item(r.task_id, r.chunk_id, r.score, r.reason, r.support_for) for r in result.selected.collect()}
    blocks: dict[str, list[Block]] = {}
    for r in result.regions.collect():
        blocks.setdefault(r.task_id, []).append(Block(r.file, r.language, r.start_line, r.end_line, r.content, [chosen[(r.task_id, k)] for k in r.chunk_ids]))
    out = []
    said = {r.task_id: r.warning for r in result.warnings.collect()}
    left = {}
    for r in result.skipped.select("task_id", "chunk_id", "score").collect():
        left.setdefault(r.task_id, []).append(item(r.task_id, r.chunk_id, r.score))
    for r in result.terms.select("task_id", "task").orderBy("task_id").collect():
        own = [*warnings, *([said[r.task_id]] if r.task_id in said else [])]
        if not blocks.get(r.task_id):
            own.append("No relevant chunks found; the result is empty.")
        out.append(Document(mode, r.task or "", blocks.get(r.task_id, []), left.get(r.task_id, []), own, dict(warning_summary or {}), config_version, None, explain))
    return out
