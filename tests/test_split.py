import pytest

from seamline.operators.split import analyze_file, base, split_files


def shape(file, source, language):
    return [(c["start_line"], c["end_line"], c["kind"], c["name"]) for c in analyze_file(file, source, language).chunks]


def test_markdown():
    text = "intro\n\n# A\ntext\n## B\n```\n# no\n```\nSet\n===\ny\n"
    assert shape("a.md", text, "markdown") == [(1, 2, "section", "preamble"), (3, 8, "section", "A"), (5, 8, "section", "A > B"), (9, 11, "section", "Set")]


def test_json_yaml_toml():
    assert shape("a.json", '{\n "a": 1,\n "b": {"c": [1,\n2]},\n "d": 3, "e": 4\n}\n', "json") == [(2, 2, "config", "a"), (3, 4, "config", "b"), (5, 5, "file", None)]
    assert shape("a.yaml", "a: 1\nb:\n  - x\nc: |\n  t\n\n---\nd: 1\n", "yaml") == [(1, 1, "config", "doc[0].a"), (2, 3, "config", "doc[0].b"), (4, 5, "config", "doc[0].c"), (8, 8, "config", "doc[1].d")]
    assert shape("a.toml", "t = [1,\n2]\n[a.b]\nx = 1\n\n# c\n[[p]]\ny=2\n[[p]]\ny=3\n", "toml") == [(1, 2, "config", "t"), (3, 4, "config", "a.b"), (7, 8, "config", "p[0]"), (9, 10, "config", "p[1]")]


def test_sql():
    text = "-- c\ncreate table if not exists a.b (x int);\n\nselect * from t where s = ';';\nwith q as (select 1) select * from q;\ncreate trigger tr after insert on t begin update x set a=1; end;\nalter table users add y int;\n"
    assert shape("a.sql", text, "sql") == [(1, 2, "table", "a.b"), (4, 4, "query", "select from t"), (5, 5, "query", "with q"), (6, 6, "function", "tr"), (7, 7, "config", "alter table users")]


def test_style_and_markup():
    scss = "$x: 1px;\n// c\n.a { b: c; &:hover { d: url(a;b) } }\n@media (x) {\n .b{}\n}\n"
    assert shape("a.scss", scss, "scss") == [(1, 1, "config", "$x"), (3, 3, "style", ".a"), (4, 6, "style", "@media (x)")]
    page = "<html><body>\n<header id=top>x</header>\n<div><section>\n<h2>Hi there</h2>\n</section></div><script>\nvar a;\n</script>\n</body></html>"
    assert shape("a.html", page, "html") == [(2, 2, "section", "header#top"), (3, 5, "section", 'section "Hi there"'), (5, 7, "section", "script")]


def test_python():
    text = "import os\n@dec\ndef f():\n  pass\nX = 1\nclass A:\n  '''d'''\n  y = 1\n\n  @property\n  def p(self): return 1\n\n  @p.setter\n  def p(self, v): pass\n"
    assert shape("a.py", text, "python") == [(2, 4, "function", "f"), (5, 5, "config", "X"), (6, 8, "class", "A"), (10, 11, "method", "A.p"), (13, 14, "method", "A.set p")]


def test_broken_python_keeps_what_parses_and_fills_the_rest():
    out = analyze_file("a.py", "def f():\n  pass\n\ndef g(:\n  x\n\ndef h():\n  return 1\n", "python")
    assert [(c["start_line"], c["kind"], c["name"]) for c in out.chunks] == [(1, "function", "f"), (4, "section", None), (7, "function", "h")]
    assert out.partial and "syntax errors" in out.warnings[0]


def test_ecmascript():
    text = """import React, { useState as us } from "react";
import "./side.css";
export const CONFIG = { a: 1 };
export function overload(a: string): string;
export function overload(a: any) {
  return /[{}]/.test(a) ? `x${a}}` : "}";
}
export default function App({ x }: Props) {
  return <div className="a">it's {x}</div>;
}
class Big {
  x = 1;

  static make() {
    return new Big();
  }
  constructor() {}
  get value() {
    return this.x;
  }
}
describe("things", () => {
  it("works", () => {});
});
"""
    got = analyze_file("a.tsx", text, "typescript").chunks
    assert [(c["start_line"], c["end_line"], c["kind"], c["name"]) for c in got] == [(3, 3, "config", "CONFIG"), (4, 7, "function", "overload"), (8, 10, "component", "App"), (11, 12, "class", "Big"), (14, 16, "method", "Big.make"), (18, 20, "method", "Big.get value"), (22, 24, "section", "describe: things")]
    refs = {(r["name"], r["specifier"], r["local"]) for r in got[0]["references"]}
    assert refs == {("useState", "react", "us"), ("default", "react", "React"), ("./side.css", "./side.css", None)}


def test_small_container_stays_whole():
    assert shape("a.py", "class A:\n  def f(self):\n    pass\n", "python") == [(1, 3, "class", "A")]


def test_windows():
    lines = ["x"] * 200
    lines[69] = lines[89] = ""  # lines 70 and 90 are equally near line 80: the earlier wins
    got = base.windows(lines, 1, 200)
    assert got[0] == (1, 69)
    covered = [i for a, b in got for i in range(a, b + 1)]
    assert len(covered) == len(set(covered)) and {i for i, x in enumerate(lines, 1) if x} <= set(covered)


@pytest.mark.parametrize("language", ["typescript", "python", "sql", "css", "scss", "html", "json", "yaml", "toml", "markdown", "go"])
@pytest.mark.parametrize("text", ["", "\n\n", "}{)(", "'unclosed", "/* open", "é😀\r\n\tx", "a: b: c\n- d", "<p><div", "\0"])
def test_anything_splits(language, text):
    out = analyze_file("f", text, language)
    lines = text.split("\n")
    for c in out.chunks:
        assert c["content"] == "\n".join(lines[c["start_line"] - 1 : c["end_line"]])


def test_split_files(spark):
    files = spark.createDataFrame([("a.py", "def f():\n  pass\n", "python"), ("b", None, "text"), ("c.go", "package x\n", "go")], "path string, source string, language string")
    rows = split_files(files).collect()
    assert sorted((r.file, r.kind, r.name) for r in rows) == [("a.py", "function", "f"), ("c.go", "file", None)]
    assert all(r.id == base.chunk_id(r.file, r.start_line, r.end_line, r.kind, r.name) for r in rows)
