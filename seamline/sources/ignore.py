"""Ignore rules in the syntax of git, as regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def _glob(pattern: str) -> str:
    """Regular expression of one path pattern without slashes at its ends."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            before, after = i == 0 or pattern[i - 1] == "/", i + 2 == len(pattern) or pattern[i + 2] == "/"
            if before and after:
                if i + 2 == len(pattern):
                    out.append(".+")
                    i += 2
                else:
                    out.append("(?:.*/)?")
                    i += 3
                continue
            out.append("[^/]*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "^", "]") else i + 1)) > 0:
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            out.append(f"[{'^/' if negated else ''}{re.sub(r'([\\\[\]^])', r'\\\1', body)}]")
            i = end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    only_directories: bool


def parse_rule(line: str) -> Rule | None:
    """A rule of one line; None for blanks and comments."""
    line = line.rstrip("\r\n")
    stripped = line.rstrip(" ")
    if stripped.endswith("\\") and len(stripped) < len(line):
        stripped += " "  # an escaped trailing blank
    if not stripped or stripped.startswith("#"):
        return None
    negated = stripped.startswith("!")
    body = stripped[1:] if negated else stripped
    directories = body.endswith("/")
    body = body.rstrip("/") if directories else body
    if not body:
        return None
    anchored = "/" in body
    prefix = "" if anchored else "(?:.*/)?"
    return Rule(re.compile(f"{prefix}{_glob(body.removeprefix('/'))}", re.I | re.S), negated, directories)


@dataclass
class Matcher:
    """Rules of one file; the last one that matches decides, and nothing comes back under an ignored directory."""

    rules: list[Rule] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Matcher:
        return cls([r for r in map(parse_rule, text.split("\n")) if r])

    def _own(self, path: str, directory: bool) -> bool | None:
        for rule in reversed(self.rules):
            if (directory or not rule.only_directories) and rule.pattern.fullmatch(path):
                return not rule.negated
        return None

    def test(self, path: str) -> bool | None:
        """True: ignored; False: brought back; None: no rule says. A trailing slash marks a directory."""
        directory, parts = path.endswith("/"), path.strip("/").split("/")
        for i in range(1, len(parts)):
            if self._own("/".join(parts[:i]), True):
                return True
        return self._own("/".join(parts), directory)

    def ignores(self, path: str) -> bool:
        return self.test(path) is True


def is_ignored(rules: list[tuple[str, Matcher]], path: str) -> bool:
    """Whether nested rule files ((directory, rules), outermost first) ignore a path; deeper ones win."""
    ignored = False
    for base, matcher in rules:
        said = matcher.test(path[len(base) + 1 :] if base else path)
        ignored = ignored if said is None else said
    return ignored
