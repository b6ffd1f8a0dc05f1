"""Markdown sections: nested, named by their heading path.

Fenced code, comments and front matter are found in the whole text and taken out. Each line left
is given a letter for what it can be, and one expression over the string of letters finds the
headings: a run of letters that reads as a list or a quote hides what looks like one inside.
"""

from __future__ import annotations

import re

from seamline.operators.split.base import Analysis, Region, assemble

FRONT = re.compile(r"---[ \t]*\n(?=[^\S\n]*\S)(?:.*\n)*?(?:---|\.\.\.)[ \t]*$", re.M)
OPAQUE = re.compile(
    r"""^\ {0,3}(?:(`{3,})[^`\n]*|(~{3,})[^\n]*)$(?:(?:\n.*)*?\n\ {0,3}(?:\1`*|\2~*)[ \t]*$|(?:\n.*)*\Z)
      | ^\ {0,3}(?P<comment><!--(?:(?:.|\n)*?-->.*|(?:.|\n)*\Z))""",
    re.M | re.X,
)
#: Letter and shape of a line. e, c and u underline a paragraph; else they are text, a list item and a rule.
LETTERS = re.compile(
    r"""(?P<b>\s*)$ | (?P<h>\ {0,3}\#{1,6}(?:[ \t].*)?)$ | (?P<e>\ {0,3}(?:=+|--)[ \t]*)$ | (?P<c>\ {0,3}-[ \t]*)$ | (?P<u>\ {0,3}-{3,}[ \t]*)$
      | (?P<r>\ {0,3}(?P<mark>[-*_])(?:[ \t]*(?P=mark)){2,}[ \t]*)$ | (?P<q>\ {0,3}(?:>|[-*+](?:[ \t]|$)|[0-9]{1,9}[.)](?:[ \t]|$))) | (?P<i>\ {4}|\t) | (?P<t>)""",
    re.X,
)
#: An ATX heading; a list or quote with all that belongs to it; a paragraph, which an underline makes a heading.
BLOCKS = re.compile(r"(?P<atx>h)|[qc][tiqcem]*|[te][ti]*(?P<under>[ecu])?|.")
CLOSING = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")


def line_letters(text: str) -> str:
    """A letter for each line: x in code and front matter, m in comments, else that of its shape."""
    letters = []
    for line in text.split("\n"):
        m = LETTERS.match(line)
        letters.append(next(k for k in "bhecurqit" if m[k] is not None))
    front = FRONT.match(text)
    hidden = [(0, front.end(), "x")] if front else []
    at = front.end() if front else 0
    while m := OPAQUE.search(text, at):
        hidden.append((m.start(), m.end(), "m" if m["comment"] else "x"))
        at = max(m.end(), m.start() + 1)
    for start, end, letter in hidden:
        first = text.count("\n", 0, start)
        for i in range(first, first + text.count("\n", start, end) + 1):
            letters[i] = letter
    return "".join(letters)


def headings(text: str) -> list[tuple[int, int, str]]:
    """(line from 0, level, name) of the headings outside code, comments, lists and quotes."""
    lines, found = text.split("\n"), []
    for m in BLOCKS.finditer(line_letters(text)):
        if m["atx"]:
            marks, _, name = lines[m.start()].strip().partition(" ") if " " in lines[m.start()].strip() else lines[m.start()].strip().partition("\t")
            found.append((m.start(), len(marks), CLOSING.sub("", name).strip()))
        elif m["under"]:
            level = 1 if "=" in lines[m.end() - 1] else 2
            found.append((m.start(), level, " ".join(x.strip() for x in lines[m.start() : m.end() - 1])))
    return found


def split_markdown(file: str, source: str, language: str = "markdown") -> Analysis:
    """A preamble, and a section a heading, which ends before the next heading of its level or above."""
    text = re.sub(r"\r$", "", source, flags=re.M).removesuffix("\n")
    last, regions, open_ = text.count("\n") + 1, [], []
    found = headings(text)
    before = found[0][0] if found else last
    if "".join(text.split("\n")[:before]).strip():
        regions.append(Region(1, before, "section", "preamble"))
    for at, level, name in found:
        while open_ and open_[-1][0] >= level:
            open_.pop()[1].end = at
        path = [*(r.name for _, r in open_[-1:]), name or "(empty heading)"]
        regions.append(Region(at + 1, last, "section", " > ".join(path)))
        open_.append((level, regions[-1]))
    return assemble(file, source, language, regions)
