"""TypeScript and JavaScript declarations and imports, by a masking lexer and a statement scanner.

Strings, comments, templates and regular expressions are blanked out at equal length, so brackets
can be matched on what is left. The scanner knows declarations, classes and their members,
namespaces, test calls and exported values; it does not parse expressions. A statement without a
semicolon ends at a line break outside brackets where neither side needs the other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from seamline.operators.split.base import Analysis, Lines, Region, assemble

WORD = r"[A-Za-z_$À-￿][\w$]*"
REGEX_BEFORE = re.compile(r"(?:^|[=(,:\[!&|?{};+\-*%~^<>]|=>|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield))\s*$")
MODIFIERS = r"(?:(?:export|default|declare|abstract|async)\s+)*"
HEAD = re.compile(rf"(?P<mods>{MODIFIERS})(?P<what>function\b\s*\*?|class\b|interface\b|type\b(?=\s+{WORD})|enum\b|const\s+enum\b|namespace\b|module\b(?=\s+[\w$\"'])|const\b|let\b|var\b)\s*(?P<name>{WORD}(?:\.{WORD})*)?")
TEST = re.compile(r"(describe|it|test)(?:\.(?:only|skip|todo|each|concurrent|failing|if|skipIf))*\s*\(")
JSX = re.compile(r"<(?:>|/|[A-Za-z][\w.]*(?:\s+[\w-]+\s*=|\s*/?>))|<[A-Za-z][\w.]*\s[^;]*?/?>")
FC_TYPE = re.compile(r":\s*(?:React\.)?(?:FC|FunctionComponent|VFC)\b")
MEMBER = re.compile(rf"(?P<mods>(?:(?:public|private|protected|static|abstract|override|readonly|declare|async|accessor)\s+)*)(?P<get>(?:get|set)\s+(?=[\w$#\[\"']))?\*?\s*(?P<name>#?{WORD}|\[[^\]]*\]|\"[^\"]*\"|'[^']*'|\d+)\s*[?!]?")
GOES_ON = re.compile(r"\s*(?:[.?:+*/%&|^=,<>)\]]|-(?!-)|instanceof\b|in\b|as\b|satisfies\b|extends\b|implements\b|from\b|of\b|else\b|catch\b|finally\b|\{)")
WAITS = re.compile(r"(?:[=(,:\[{?&|+\-*/%^<.!~]|=>|\b(?:extends|implements|return|typeof|new|in|of|as|from|import|export|default|const|let|var|function|class|interface|type|async|await))\s*$")
KINDS = {"interface": "interface", "type": "type", "enum": "type", "const enum": "type"}
OPEN, CLOSE = "([{", ")]}"


def mask(source: str) -> tuple[str, bool]:
    """The source with the text of literals and comments as blanks; and whether one is left open."""
    out, i, n, broken = list(source), 0, len(source), False

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = source[i]
        if source.startswith("//", i) or source.startswith("#!", i) and i == 0:
            end = source.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif source.startswith("/*", i):
            end = source.find("*/", i + 2)
            broken |= end < 0
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif c in "\"'":
            j = i + 1
            while j < n and source[j] not in (c, "\n"):
                j += 2 if source[j] == "\\" else 1
            if j < n and source[j] == c:
                blank(i + 1, j)
                i = j + 1
            else:
                i += 1  # an apostrophe in JSX text
        elif c == "`":
            j = _template_end(source, i)
            broken |= j > n
            blank(i + 1, min(j, n) - 1)
            i = min(j, n)
        elif c == "/" and (m := re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(source, i)) and REGEX_BEFORE.search("".join(out[max(0, i - 24) : i])):
            blank(i, m.end())
            i = m.end()
        else:
            i += 1
    return "".join(out), broken


def _template_end(source: str, i: int) -> int:
    """Offset after a template literal; past the source's end where it is open."""
    i += 1
    while i < len(source):
        if source[i] == "\\":
            i += 2
        elif source[i] == "`":
            return i + 1
        elif source.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(source) and depth:
                if source[i] == "`":
                    i = _template_end(source, i)
                    continue
                depth += {"{": 1, "}": -1}.get(source[i], 0)
                i += 1
        else:
            i += 1
    return len(source) + 1


def match_brackets(code: str) -> tuple[dict[int, int], bool]:
    """Closing offset of each opening bracket; and whether they do not fit."""
    pairs, stack, broken = {}, [], False
    for i, c in enumerate(code):
        if c in OPEN:
            stack.append(i)
        elif c in CLOSE:
            if stack and OPEN.index(code[stack[-1]]) == CLOSE.index(c):
                pairs[stack.pop()] = i
            else:
                broken = True
    return pairs, broken or bool(stack)


@dataclass
class Found:
    start: int
    end: int
    kind: str
    name: str
    parent: Found | None = None
    signature: bool = False
    static: bool = False


class _Scanner:
    def __init__(self, source: str) -> None:
        self.source = source
        self.code, open_literal = mask(source)
        self.pairs, open_bracket = match_brackets(self.code)
        self.broken = open_literal or open_bracket

    def statements(self, at: int, end: int) -> list[tuple[int, int]]:
        """(start, end) of the statements between two offsets."""
        out, i, code = [], at, self.code
        while i < end:
            if code[i].isspace() or code[i] == ";":
                i += 1
                continue
            stop = self._statement_end(i, end)
            out.append((i, stop))
            i = max(stop, i + 1)
        return out

    def _statement_end(self, start: int, end: int) -> int:
        code, i = self.code, start
        while code[i : i + 1] == "@":  # decorators belong to what follows
            i = re.compile(rf"@\s*{WORD}(?:\.{WORD})*").match(code, i).end() if re.compile(rf"@\s*{WORD}").match(code, i) else i + 1
            if code[i : i + 1] == "(" and i in self.pairs:
                i = self.pairs[i] + 1
            while i < end and code[i].isspace():
                i += 1
        head = HEAD.match(code, i)
        block = bool(head and re.match(r"function|class|interface|enum|const\s+enum|namespace|module", head["what"])) or bool(re.match(r"declare\s+global\b", code[i : i + 40]))
        while i < end:
            c = code[i]
            if c in OPEN and i in self.pairs:
                was, i = c, self.pairs[i] + 1
                if block and was == "{" and not re.match(r"\s*(?:\||&|=>|extends\b|implements\b|\{)", code[i : i + 40]):
                    return i
                continue
            if c == ";":
                return i + 1
            if c == "\n" and code[start:i].strip() and not WAITS.search(code[start:i]) and not GOES_ON.match(code, i + 1):
                rest = code[i:end]
                if not GOES_ON.match(rest.lstrip()[:20]):
                    return i
            i += 1
        return len(code[start:end].rstrip()) + start

    def body(self, start: int, end: int) -> tuple[int, int] | None:
        """Inside of the first braces at the statement's own level, past type arguments and parents."""
        i, last = start, None
        while i < end:
            if self.code[i] in OPEN and i in self.pairs:
                if self.code[i] == "{":
                    last = (i + 1, self.pairs[i])
                i = self.pairs[i]
            i += 1
        return last

    def _is_function(self, value: str) -> bool:
        return bool(re.match(rf"(?:async\s+)?(?:function\b|(?:<[^=]*?>\s*)?\(|{WORD}\s*=>)", value)) and ("=>" in value or "function" in value[:20])

    def function_kind(self, start: int, end: int, name: str, default: bool = False, typed: str = "") -> str:
        named = default or name == "default" or name[:1].isupper()
        return "component" if named and (FC_TYPE.search(typed) or JSX.search(self.code[start:end])) else "function"

    def declared(self, start: int, end: int) -> list[Found | None]:
        """Declarations of one statement."""
        code, i = self.code, start
        while code[i : i + 1] == "@":
            m = re.compile(rf"@\s*{WORD}(?:\.{WORD})*").match(code, i)
            i = m.end() if m else i + 1
            if code[i : i + 1] == "(" and i in self.pairs:
                i = self.pairs[i] + 1
            while i < end and code[i].isspace():
                i += 1
        exported, default = code.startswith("export", i), bool(re.match(r"export\s+default\b", code[i:end]))
        head = HEAD.match(code, i, end)
        if head and head["what"].split()[0] in ("namespace", "module"):
            return self.namespace(start, end, head.end("what"))
        if head and head["name"] is None and not default:
            head = None
        if head:
            what, name = re.sub(r"\s*\*$", "", re.sub(r"\s+", " ", head["what"]).strip()), head["name"] or "default"
            if what == "function":
                has_body = self.code[start:end].rstrip().endswith("}")
                return [Found(start, end, self.function_kind(head.end(), end, name, default) if has_body else "function", name, signature=not has_body)]
            if what == "class":
                return self.class_members(Found(start, end, "class", name if name not in ("extends", "implements") else "default"), head.end(), end)
            if what in KINDS:
                return [Found(start, end, KINDS[what], name)]
            if what in ("const", "let", "var"):
                return self.variables(start, end, head.end("what"), exported)
        if default:
            value = re.compile(r"export\s+default\s+").match(code, i).end()
            text = code[value:end].strip()
            if self._is_function(text):
                return [Found(start, end, self.function_kind(value, end, "default", True), "default")]
            return [] if re.fullmatch(rf"{WORD}\s*;?", text) else [Found(start, end, "config", "default")]
        if not exported and (test := TEST.match(code, i, end)):
            inside = self.source[test.end() : self.pairs.get(test.end() - 1, end)].strip()
            quoted = re.match(r"(?s)(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.)*`)", inside)
            title = quoted[1][1:-1] if quoted else re.split(r"[,\n]", inside)[0].strip()
            return [Found(start, end, "section", f"describe: {title}") if test[1] == "describe" else Found(start, end, "function", f"test: {title}")]
        return []

    def variables(self, start: int, end: int, at: int, exported: bool) -> list[Found | None]:
        out: list[Found | None] = []
        for a, b in self._split(at, end, ","):
            m = re.compile(rf"\s*({WORD})\s*(?:!?:\s*([^=]*(?:=>[^=]*)?))?=(?!=|>)\s*").match(self.code, a, b)
            if not m:
                bare = re.compile(rf"\s*({WORD})\s*(?::|;|$)").match(self.code, a, b)
                if bare and exported:
                    out.append(Found(start, end, "config", bare[1]))
                continue
            value = re.sub(r"^\(+\s*(?=(?:async\s+)?function\b|class\b)", "", self.code[m.end() : b])
            if self._is_function(value):
                out.append(Found(start, end, self.function_kind(m.end(), b, m[1], typed=f": {m[2] or ''}"), m[1]))
            elif re.match(r"class\b", value):
                out += self.class_members(Found(start, end, "class", m[1]), m.end(), b)
            elif exported:
                out.append(Found(start, end, "config", m[1]))
        return out

    def _split(self, at: int, end: int, by: str) -> list[tuple[int, int]]:
        parts, a, i, angle = [], at, at, 0
        while i < end:
            c = self.code[i]
            if c in OPEN and i in self.pairs:
                i = self.pairs[i]
            elif c == "<" and re.match(r"[\w$]", self.code[i - 1 : i]):
                angle += 1
            elif c == ">" and angle and self.code[i - 1] != "=":
                angle -= 1
            elif c == by and not angle:
                parts.append((a, i))
                a = i + 1
            i += 1
        return [*parts, (a, end)]

    def class_members(self, header: Found, at: int, end: int) -> list[Found | None]:
        inside = self.body(at, end)
        out: list[Found | None] = []
        i, stop = inside or (0, 0)
        while i < stop:
            if self.code[i].isspace() or self.code[i] == ";":
                i += 1
                continue
            close = self._member_end(i, stop)
            out.append(self._member(header, i, close))
            i = max(close, i + 1)
        plain = {m.name for m in out if m and not m.static}
        return [header, *(replace(m, name=f"{header.name}.static {m.name[len(header.name) + 1 :]}") if m and m.static and m.name in plain else m for m in out)]

    def _after_decorators(self, i: int, end: int) -> int:
        while self.code[i : i + 1] == "@":
            m = re.compile(rf"@\s*{WORD}(?:\.{WORD})*").match(self.code, i)
            i = m.end() if m else i + 1
            if self.code[i : i + 1] == "(" and i in self.pairs:
                i = self.pairs[i] + 1
            while i < end and self.code[i].isspace():
                i += 1
        return i

    def _member_end(self, start: int, end: int) -> int:
        i, assigned, called = self._after_decorators(start, end), False, False
        first = i
        while i < end:
            c = self.code[i]
            if c in OPEN and i in self.pairs:
                i = self.pairs[i] + 1
                if c == "{" and not assigned and (called or not re.search(r"[:|&]\s*$", self.code[first : self.code.rfind("{", first, i)] or "")):
                    return i
                called |= c == "("
                continue
            if c == ";":
                return i + 1
            assigned |= c == "=" and self.code[i : i + 2] != "=="
            if c == "\n" and self.code[first:i].strip() and not WAITS.search(self.code[first:i]) and not GOES_ON.match(self.code[i:end].lstrip()[:20]):
                return i
            i += 1
        return end

    def _member(self, header: Found, start: int, end: int) -> Found | None:
        at = self._after_decorators(start, end)
        m = MEMBER.match(self.code, at, end)
        if not m:
            return None
        name = self.source[m.start("name") : m.end("name")]
        rest = self.code[m.end() : end].lstrip()
        method = rest.startswith(("(", "<"))
        field = re.match(r"(?::[^=]*(?:=>[^=]*)*)?=(?!=|>)\s*", rest)
        function = bool(field) and self._is_function(rest[field.end() :])
        if name == "constructor" or not (method or function):
            return None
        done = len(self.code[start:end].rstrip()) + start
        return Found(start, done, "method", f"{header.name}.{(m['get'] or '').strip() + ' ' if m['get'] else ''}{name}", header, method and not self.code[start:done].endswith("}"), "static" in m["mods"].split())

    def namespace(self, start: int, end: int, at: int) -> list[Found | None]:
        m = re.compile(rf"\s*(?:({WORD}(?:\.{WORD})*)|([\"'])([^\"']*)\2)").match(self.source, at, end)
        inside = self.body(at, end)
        if not m or not inside:
            return []
        header = Found(start, end, "section", m[1] or m[3])
        return [header, *(replace_parent(f, header) if f else None for f in self.entries(*inside))]

    def entries(self, at: int, end: int) -> list[Found | None]:
        out: list[Found | None] = []
        for a, b in self.statements(at, end):
            out += self.declared(a, b) or [None]
        return out


def replace_parent(f: Found, header: Found) -> Found:
    """A member of a namespace; members of members keep their own parent."""
    f.name = f"{header.name}.{f.name}"
    f.parent = f.parent or header
    return f


def merge_overloads(found: list[Found | None]) -> list[Found]:
    """Neighbouring signatures of one name, with the implementation that follows them, are one."""
    out: list[Found] = []
    run: Found | None = None
    for f in [*found, None]:
        same = f is not None and run is not None and (f.name, f.kind) == (run.name, run.kind)
        if same:
            f.start = run.start
        elif run is not None:
            out.append(run)
        run = None
        if f is not None and f.signature:
            run = f
        elif f is not None:
            out.append(f)
    return out


IMPORT = re.compile(r"(?:import|export)\b")


def references(scan: _Scanner) -> list[dict]:
    """Imports, re-exports, require and dynamic import, with what they bind."""
    out, code, source, lines = [], scan.code, scan.source, Lines(scan.source)

    def add(at: int, name: str, spec: str | None, local: str | None = None, namespace: bool = False) -> None:
        out.append({"kind": "import", "line": lines.of(at), "name": name, "specifier": spec, "local": local if local != name else None, "namespace": namespace or None, "target_chunk_id": None, "evidence": None if spec is not None else "unresolved"})

    for a, b in scan.statements(0, len(code)):
        if not IMPORT.match(code, a):
            continue
        text = source[a:b]
        spec = re.search(r"""(?:\bfrom\s*|^import\s*)(["'])(.*?)\1""", text)
        if code.startswith("import", a) and (eq := re.match(rf"import\s+(?:type\s+)?({WORD})\s*=\s*require\(\s*([\"'])(.*?)\2", text)):
            add(a, eq[1], eq[3], None, True)
            continue
        if not spec:
            continue
        head, path = re.sub(r"\bfrom\s*$", "", text[: spec.start(1)]), spec[2]
        names = re.search(r"\{(.*)\}", head, re.S)
        if star := re.search(rf"\*\s*(?:as\s+({WORD}))?", head):
            add(a, "*", path, star[1], True)
        if names:
            for part in names[1].split(","):
                if m := re.match(rf"\s*(?:type\s+)?({WORD}|\"[^\"]*\")(?:\s+as\s+({WORD}))?\s*$", part.split("//")[0]):
                    add(a, m[1], path, m[2] if head.startswith("import") else None)
        if head.startswith("import") and (default := re.match(rf"import\s+(?:type\s+(?!from\b))?({WORD})\s*(?:,|$)", head.strip())):
            add(a, "default", path, default[1])
        if not names and not star and re.match(r"import\s*$", head):
            add(a, path, path)
    for m in re.finditer(r"\b(?:require|import)\s*\(", code):
        if m.start() and code[m.start() - 1] in ".$" or m.end() - 1 not in scan.pairs:
            continue
        inner = source[m.end() : scan.pairs[m.end() - 1]].strip()
        literal = re.fullmatch(r"""(["'`])([^"'`$]*)\1""", inner)
        before = re.search(rf"import\s+(?:type\s+)?{WORD}\s*=\s*$", code[: m.start()])
        if not before:
            add(m.start(), literal[2] if literal else inner, literal[2] if literal else None, None, bool(literal))
    return sorted(out, key=lambda r: r["line"])


def split_ecmascript(file: str, source: str, language: str = "typescript") -> Analysis:
    scan = _Scanner(source)
    found = merge_overloads(scan.entries(0, len(source)))
    if not found and not scan.broken:
        body = [(a, b) for a, b in scan.statements(0, len(source)) if not scan.code.startswith("import", a)]
        if any(re.match(r"export\s+default\b", scan.code[a:b]) for a, b in body):
            found = [Found(body[0][0], body[-1][1], "config", "default")]
    lines, regions = Lines(source), {}
    for f in found:
        end = len(source[: f.end].rstrip())
        regions[id(f)] = Region(lines.of(f.start), lines.of(max(f.start, end - 1)), f.kind, f.name, regions.get(id(f.parent)) if f.parent else None)
    return assemble(file, source, language, list(regions.values()), scan.broken, "declarations", references(scan))
