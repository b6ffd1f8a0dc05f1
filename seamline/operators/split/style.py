"""Top-level statements of CSS and SCSS files, by one brace scanner."""

from __future__ import annotations

import re

from seamline.operators.split.base import Analysis, Lines, Region, assemble, collapse

STRING = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|\'(?:[^\'\\\n]|\\.)*(?:\'|(?=\n)|\Z)'
TOKEN = re.compile(rf"""(?P<space>\s+)|(?P<comment>/\*.*?(?:\*/|\Z)|(?P<line>//[^\n]*))|(?P<string>{STRING})|(?P<url>url\(\s*(?!["'])[^)]*\))|(?P<hole>\#\{{)|(?P<open>\{{)|(?P<close>\}})|(?P<semi>;)|(?P<other>[^\s/"'#{{}};u]+|.)""", re.S | re.I)


def statements(source: str, scss: bool) -> tuple[list[tuple[int, int, int | None]], bool]:
    """(start, end, start of the body) of each top-level statement; and whether braces or strings stay open."""
    out: list[tuple[int, int, int | None]] = []
    start = body = None
    depth, last, broken, i, holes = 0, 0, False, 0, []
    while i < len(source):
        m = TOKEN.match(source, i)
        kind = m.lastgroup
        if kind == "line" or m["line"]:
            kind = "comment" if scss else "other"
            if not scss:  # two slashes are no comment in plain CSS
                m = re.compile("/").match(source, i)
        i = m.end()
        if kind in ("space", "comment"):
            broken |= kind == "comment" and m[0].startswith("/*") and not m[0].endswith("*/")
            continue
        if start is None and kind != "close":
            start = m.start()
        last = m.end()
        if kind == "hole":
            holes.append(depth)
        elif kind == "open":
            if not depth and not holes:
                body = m.start()
            depth += not holes
        elif kind == "close":
            if holes:
                holes.pop()
            elif not depth:
                broken = True
                start = None
            else:
                depth -= 1
                if not depth:
                    out.append((start, m.end(), body))
                    start = body = None
        elif kind == "semi" and not depth and not holes:
            out.append((start, m.end(), None))
            start = None
    if start is not None:
        out.append((start, last, body))
        broken |= depth > 0 or bool(holes)
    return out, broken


def classify(text: str, body: int | None) -> tuple[str, str]:
    """(kind, name): rules and at-rules with a body are styles, the rest configuration."""
    head = collapse(re.sub(r"/\*.*?\*/", " ", text if body is None else text[:body], flags=re.S)).rstrip(";").strip()
    if body is not None:
        return "style", head
    named = re.match(r"(\$[\w-]+|--[\w-]+)\s*:", head)
    return "config", named[1] if named else head


def split_style(file: str, source: str, language: str) -> Analysis:
    found, broken = statements(source, language == "scss")
    lines = Lines(source)
    regions = [Region(lines.of(a), lines.of(b - 1), *classify(source[a:b], None if body is None else body - a)) for a, b, body in found]
    return assemble(file, source, language, regions, broken)
