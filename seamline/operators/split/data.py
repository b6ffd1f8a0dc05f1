"""Top-level entries of JSON, YAML and TOML files."""

from __future__ import annotations

import json
import re

from seamline.operators.split.base import Analysis, Lines, Region, assemble, blank, collapse


def one_line(name: str) -> str:
    return collapse(name) if "\n" in name or "\r" in name else name


def json_key(raw: str) -> str:
    """A quoted key without its quotes; as written where it is empty or holds a line break."""
    try:
        name = json.loads(raw)
    except ValueError:
        return one_line(raw.strip("\"'"))
    return raw if name == "" or "\n" in name or "\r" in name else name


class _Json:
    """A lenient scanner with positions; comments are blanks."""

    TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"/]+|.', re.S)

    def __init__(self, source: str) -> None:
        every = [(m[0], m.start(), m.end()) for m in self.TOKEN.finditer(source)]
        self.comments = any(t.startswith(("//", "/*")) for t, *_ in every)
        self.tokens = [t for t in every if not t[0].isspace() and not t[0].startswith(("//", "/*"))]

    def entries(self) -> tuple[list[tuple[str | None, int, int]], bool]:
        """(key, start, end) of the top object's pairs, or of the whole value; and whether it is broken."""
        if not self.tokens:
            return [], False
        if self.tokens[0][0] != "{":
            return [(None, self.tokens[0][1], self.tokens[-1][2])], False
        out, i, broken, n = [], 1, False, len(self.tokens)
        while i < n and self.tokens[i][0] != "}":
            key, start, _ = self.tokens[i]
            if key == ",":
                i += 1
                continue
            if not key.startswith('"') or i + 1 >= n or self.tokens[i + 1][0] != ":":
                broken = True
                i += 1
                continue
            depth, j = 0, i + 2
            while j < n and (depth or self.tokens[j][0] not in ",}"):
                depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(self.tokens[j][0], 0)
                j += 1
            broken |= j >= n or j == i + 2
            out.append((json_key(key), start, self.tokens[min(j, n) - 1][2]))
            i = j
        return out, broken or i >= n


YAML_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\-\[\]{}&*!|>%@`"',?][^#]*?|[-?](?=\S)[^#]*?)\s*:(?=\s|$)""")


def yaml_key(raw: str) -> str:
    if raw.startswith('"'):
        return json_key(raw)
    return one_line(raw[1:-1].replace("''", "'")) if raw.startswith("'") else one_line(raw)


def yaml_entries(source: str) -> list[tuple[str | None, int, int]]:
    """(name, first line, last line) of the top-level keys of each document; a body without keys is one entry."""
    lines = source.split("\n")
    documents: list[list[int]] = [[]]
    for i, line in enumerate(lines, 1):
        if re.match(r"---(\s|$)", line):
            documents.append([i] if line[3:].strip() and not line[3:].strip().startswith("#") else [])
        elif re.match(r"\.\.\.(\s|$)", line) or line.startswith("%"):
            continue
        else:
            documents[-1].append(i)
    if not any(not blank(lines[i - 1]) and not lines[i - 1].lstrip().startswith("#") for i in documents[0]):
        documents = documents[1:] or documents
    body = lambda i: not blank(lines[i - 1]) and not lines[i - 1].lstrip().startswith("#")
    filled = [d for d in documents if any(map(body, d))]
    out = []
    for n, d in enumerate(documents):
        if d not in filled:
            continue
        label = f"doc[{n}]" if len(filled) > 1 else None
        keys = [(i, m) for i in d if (m := YAML_KEY.match(lines[i - 1]))]
        if not keys:
            used = [i for i in d if body(i)]
            out.append((label, used[0], used[-1]))
            continue
        for k, (i, m) in enumerate(keys):
            last = keys[k + 1][0] - 1 if k + 1 < len(keys) else d[-1]
            while last > i and (blank(lines[last - 1]) or lines[last - 1].startswith("#")):
                last -= 1
            out.append((f"{label}.{yaml_key(m[1])}" if label else yaml_key(m[1]), i, last))
    return out


TOML_TABLE = re.compile(r"\s*(\[\[?)\s*([^\]]+?)\s*\]\]?\s*(?:#.*)?$")
TOML_PAIR = re.compile(r"""\s*((?:[A-Za-z0-9_-]+|"(?:[^"\\]|\\.)*"|'[^']*')(?:\s*\.\s*(?:[A-Za-z0-9_-]+|"(?:[^"\\]|\\.)*"|'[^']*'))*)\s*=""")


def toml_key(raw: str) -> str:
    return re.sub(r"""\s*\.\s*(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", ".", raw)


def toml_entries(source: str) -> tuple[list[tuple[str, int, int]], bool]:
    """(name, first line, last line) of top-level pairs and of tables; arrays of tables are numbered."""
    lines = source.split("\n")
    out: list[list] = []
    counts: dict[str, int] = {}
    in_table, broken, i = False, False, 0
    while i < len(lines):
        line, first = lines[i], i + 1
        if blank(line) or line.lstrip().startswith("#"):
            i += 1
            continue
        if table := TOML_TABLE.match(line):
            name = toml_key(table[2])
            if table[1] == "[[":
                counts[name] = counts.get(name, -1) + 1
                name = f"{name}[{counts[name]}]"
            out.append([name, first, first])
            in_table = True
        elif pair := TOML_PAIR.match(line):
            value, last = line[pair.end() :], i
            while last + 1 < len(lines) and _open(value):
                last += 1
                value += "\n" + lines[last]
            if in_table:
                out[-1][2] = last + 1
            else:
                out.append([toml_key(pair[1]), first, last + 1])
            i = last
        else:
            broken = True
        i += 1
    return [tuple(e) for e in out], broken


def _open(value: str) -> bool:
    """Whether a value goes on: inside a long string or an unclosed bracket."""
    rest = re.sub(r'"""(?:[^\\]|\\.)*?"""|\'\'\'.*?\'\'\'', "", value, flags=re.S)
    if '"""' in rest or "'''" in rest:
        return True
    rest = re.sub(r'"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|#[^\n]*', "", rest)
    return rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}")


def split_data(file: str, source: str, language: str) -> Analysis:
    warnings = []
    if language == "yaml":
        found, broken = yaml_entries(source), False
    elif language == "toml":
        found, broken = toml_entries(source)
    else:
        scanner, lines = _Json(source), Lines(source)
        pairs, broken = scanner.entries()
        found = [(k, lines.of(s), lines.of(e - 1)) for k, s, e in pairs]
        if scanner.comments:
            warnings = [f"{file}: contains comments (JSONC); parsed leniently"]
    ranges: dict[tuple[int, int], list[str | None]] = {}
    for name, a, b in found:
        ranges.setdefault((a, b), []).append(name)
    # entries that share their lines are one chunk, not copies of it
    regions = [Region(a, b, "config" if len(names) == 1 and names[0] and not re.fullmatch(r"doc\[\d+\]", names[0]) else "file", names[0] if len(names) == 1 else None) for (a, b), names in ranges.items()]
    out = assemble(file, source, language, regions, broken, "entries")
    out.warnings += warnings
    return out
