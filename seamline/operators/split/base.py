"""Regions to chunks: exact lines, container policy, references, text windows over what is left."""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass, field

SMALL_CONTAINER, WINDOW, WINDOW_MAX = 5, 80, 100
MAX_REASON = 200


@dataclass(eq=False)
class Region:
    """A 1-based inclusive range of lines that declares something; a parent comes before its members."""

    start: int
    end: int
    kind: str
    name: str | None = None
    parent: Region | None = None


@dataclass
class Analysis:
    chunks: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    partial: bool = False
    text_only: bool = False


class Lines:
    """Offsets of a source's lines; only \\n ends a line."""

    def __init__(self, source: str) -> None:
        self.text = source.split("\n")
        self.starts = [0]
        for line in self.text[:-1]:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def of(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


def blank(line: str) -> bool:
    return not line.strip()


def collapse(text: str) -> str:
    return " ".join(text.split())


def chunk_id(file: str, start: int, end: int, kind: str, name: str | None) -> str:
    return hashlib.sha256(f"{file}:{start}-{end}:{kind}:{name or ''}".encode("utf-8", "replace")).hexdigest()[:12]


def place_containers(regions: list[Region], lines: list[str]) -> list[tuple[Region, int]]:
    """(region, end) after the container policy: a small container, or one whose members share lines
    with it or each other, stays whole without its members; another ends before its first member."""
    members: dict[int, list[Region]] = {}
    for r in regions:
        if r.parent is not None:
            members.setdefault(id(r.parent), []).append(r)
    gone: set[int] = set()
    ends: dict[int, int] = {}

    def drop(r: Region) -> None:
        for m in members.get(id(r), ()):
            gone.add(id(m))
            drop(m)

    for r in regions:
        own = sorted(members.get(id(r), ()), key=lambda m: m.start)
        if not own or id(r) in gone:
            continue
        end = own[0].start - 1
        while end > r.start and blank(lines[end - 1]):
            end -= 1
        apart = all(b.start > a.end for a, b in zip(own, own[1:], strict=False))
        if r.end - r.start + 1 > SMALL_CONTAINER and r.start <= end and own[0].start > r.start and apart:
            ends[id(r)] = end
        else:
            drop(r)
    return [(r, ends.get(id(r), r.end)) for r in regions if id(r) not in gone]


def attach_references(file: str, refs: list[dict], ranges: list[tuple[int, int]]) -> list[list[dict]]:
    """References of each range: those of its lines, and those that no range covers."""
    loose = [not any(s <= r["line"] <= e for s, e in ranges) for r in refs]
    return [[r for r, free in zip(refs, loose, strict=True) if free or s <= r["line"] <= e] for s, e in ranges]


def assemble(file: str, source: str, language: str, regions: list[Region], broken: bool = False, unit: str = "chunks", refs: list[dict] | None = None) -> Analysis:
    """Chunks of regions; identical ones collapse."""
    lines = source.split("\n")
    placed = place_containers(regions, lines)
    own_refs = attach_references(file, refs or [], [(r.start, end) for r, end in placed])
    ids: dict[int, str] = {}
    out: dict[str, dict] = {}
    for (r, end), found in zip(placed, own_refs, strict=True):
        ids[id(r)] = key = chunk_id(file, r.start, end, r.kind, r.name)
        parent = ids.get(id(r.parent)) if r.parent else None
        out[key] = {
            "id": key,
            "file": file,
            "language": language,
            "kind": r.kind,
            "name": r.name,
            "start_line": r.start,
            "end_line": end,
            "content": "\n".join(lines[r.start - 1 : end]),
            "parent_id": parent,
            "container_name": r.parent.name if parent else None,
            "references": found,
        }
    warnings = [f"{file}: syntax errors; extracted {len(out)} {unit} from the parseable regions"] if broken else []
    return Analysis(list(out.values()), warnings, broken)


def windows(lines: list[str], first: int, last: int) -> list[tuple[int, int]]:
    """Ranges of about WINDOW lines that end on the nearest blank line (the earlier of two), without
    blank edges; every line that is not blank is in one of them."""
    out, at = [], first
    while at <= last:
        end = last
        if last - at + 1 > WINDOW:
            want = at + WINDOW - 1
            stops = [k for k in range(at + WINDOW // 2 - 1, min(at + WINDOW_MAX - 1, last - 1) + 1) if blank(lines[k - 1])]
            end = min(stops, key=lambda k: (abs(k - want), k), default=want)
        a, b = at, end
        while a <= b and blank(lines[a - 1]):
            a += 1
        while b >= a and blank(lines[b - 1]):
            b -= 1
        if a <= b:
            out.append((a, b))
        at = end + 1
    return out


def text_fallback(file: str, source: str, language: str, reason: str, covered: list[tuple[int, int]] = ()) -> Analysis:
    """Windows over all lines that no covered range holds."""
    lines = source.split("\n")
    free = [True] * (len(lines) + 2)
    free[0] = free[-1] = False
    for s, e in covered:
        for i in range(max(1, s), min(e, len(lines)) + 1):
            free[i] = False
    found, start = [], None
    for i in range(1, len(lines) + 2):
        if free[i] and start is None:
            start = i
        elif not free[i] and start is not None:
            found += windows(lines, start, i - 1)
            start = None
    if not found:
        return Analysis()
    kind = "file" if not covered and len(found) == 1 else "section"
    out = assemble(file, source, language, [Region(a, b, kind) for a, b in found])
    where = " over the lines the parser did not recover" if covered else ""
    out.warnings = [f"{file}: {reason}; text fallback produced {len(out.chunks)} line window(s){where}"]
    return out
