"""Python declarations and imports."""

from __future__ import annotations

import ast
import re

from seamline.operators.split.base import Analysis, Region, assemble

CONSTANT = re.compile(r"_*[A-Z][A-Z0-9_]*")
ACCESSORS = {"setter": "set", "getter": "get", "deleter": "delete"}


def first_line(node: ast.AST) -> int:
    """First line of a statement, its decorators included."""
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


def accessor(node: ast.AST) -> str | None:
    for d in node.decorator_list:
        if isinstance(d, ast.Attribute) and isinstance(d.value, ast.Name) and d.attr in ACCESSORS:
            return f"{ACCESSORS[d.attr]} {d.value.id}"
    return None


def main_guard(node: ast.stmt) -> bool:
    match node:
        case ast.If(test=ast.Compare(left=a, ops=[ast.Eq()], comparators=[b]), orelse=[]):
            said = [x.id if isinstance(x, ast.Name) else x.value if isinstance(x, ast.Constant) else None for x in (a, b)]
            return sorted(map(str, said)) == ["__main__", "__name__"] and any(isinstance(x, ast.Name) for x in (a, b))
    return False


def constant(node: ast.stmt) -> str | None:
    match node:
        case ast.AnnAssign(target=ast.Name(id=name)):
            return name
        case ast.Assign(targets=[ast.Name(id=name)]) if CONSTANT.fullmatch(name):
            return name
    return None


def blocks_of(node: ast.stmt) -> list[ast.stmt]:
    """Statements inside control flow, which makes no scope of its own."""
    if not isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While | ast.Try | ast.TryStar | ast.With | ast.AsyncWith | ast.Match):
        return []
    inner = [*getattr(node, "body", ()), *(s for h in getattr(node, "handlers", ()) for s in h.body), *(s for c in getattr(node, "cases", ()) for s in c.body)]
    return [*inner, *getattr(node, "orelse", ()), *getattr(node, "finalbody", ())]


def collect(body: list[ast.stmt], owner: Region | None, found: list[Region]) -> None:
    for node in body:
        prefix = f"{owner.name}." if owner else ""
        span = lambda: (first_line(node), node.end_lineno)  # noqa: B023, E731
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            name = (accessor(node) if owner else None) or node.name
            found.append(Region(*span(), "method" if owner else "function", prefix + name, owner))
        elif isinstance(node, ast.ClassDef):
            region = Region(*span(), "class", prefix + node.name, owner)
            found.append(region)
            collect(node.body, region, found)
        elif owner is None and main_guard(node):
            found.append(Region(*span(), "section", "__main__"))
        elif owner is None and (name := constant(node)):
            found.append(Region(*span(), "config", name))
        elif inner := blocks_of(node):
            collect(inner, owner, found)


def reference(line: int, name: str, specifier: str | None, local: str | None = None, namespace: bool = False) -> dict:
    return {"kind": "import", "line": line, "name": name, "specifier": specifier, "local": local, "namespace": namespace or None, "target_chunk_id": None, "evidence": None if specifier else "unresolved"}


def references(tree: ast.AST) -> list[dict]:
    out = []
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                out += [reference(node.lineno, a.name, a.name, a.asname if a.asname and a.asname != a.name else None, True) for a in names]
            case ast.ImportFrom(module=module, names=names, level=level):
                spec = "." * level + (module or "")
                out += [reference(node.lineno, a.name, spec, a.asname if a.asname and a.asname != a.name else None) for a in names]
            case ast.Call(func=ast.Name(id="__import__")) | ast.Call(func=ast.Attribute(value=ast.Name(id="importlib"), attr="import_module")):
                given = node.args[0] if node.args else next((k.value for k in node.keywords if k.arg == "name"), None)
                literal = given.value if isinstance(given, ast.Constant) and isinstance(given.value, str) else None
                out.append(reference(node.lineno, literal or ast.unparse(given) if given is not None else "", literal, None, True))
    return sorted(out, key=lambda r: r["line"])


def longest_valid(source: str) -> list[tuple[int, ast.Module]]:
    """(line offset, tree) of the top-level statements that parse, where the file as a whole does not:
    lines are grouped at column 0 and each group is tried alone."""
    groups: list[list[int]] = []
    for i, line in enumerate(source.split("\n")):
        opener = line[:1] not in ("", " ", "\t", "\r", "#", ")", "]", "}")
        goes_on = re.match(r"(else|elif|except|finally)\b", line) or (groups and source.split("\n")[groups[-1][-1]].lstrip().startswith("@"))
        if opener and not goes_on or not groups:
            groups.append([])
        groups[-1].append(i)
    lines, out = source.split("\n"), []
    for g in groups:
        try:
            out.append((g[0], ast.parse("\n".join(lines[i] for i in g))))
        except (SyntaxError, ValueError):
            continue
    return out


def split_python(file: str, source: str, language: str = "python") -> Analysis:
    # form feeds and lone carriage returns end no line here, as elsewhere
    text = source.replace("\r", " ").replace("\f", " ").removeprefix("\ufeff")
    try:
        parts, broken = [(0, ast.parse(text))], False
    except (SyntaxError, ValueError):
        parts, broken = longest_valid(text), True
    regions, refs = [], []
    for offset, tree in parts:
        ast.increment_lineno(tree, offset)
        collect(tree.body, None, regions)
        refs += references(tree)
    return assemble(file, source, language, regions, broken and bool(source.strip()), "declarations", refs)
