"""Which files of a directory are read: a sorted walk with exclusions, each with its reason."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from seamline.config import MAX_FILE_BYTES, MAX_SCAN_BYTES, MAX_SCAN_DEPTH, MAX_SCAN_FILES
from seamline.sources.ignore import Matcher, is_ignored

# Names that are never entered or read.
SKIPPED_DIRECTORIES = frozenset(
    "node_modules .git dist build out .next target coverage venv .venv __pycache__ .claude .codex .cursor .windsurf .gemini .aider.tags.cache.v3 .cline .roo .kiro .continue .junie .conductor .worktrees".split()
)
LOCKFILES = frozenset("bun.lock bun.lockb package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock Gemfile.lock composer.lock go.sum uv.lock".split())
SECRETS = Matcher.of("\n".join([".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa*", "*secret*", "*credential*", ".npmrc", ".netrc", "*.keystore"]))
MINIFIED = re.compile(r"\.min\.(js|css|mjs)$")
SNIFF_BYTES = 8192
#: Root file whose rules only ever subtract.
EXTRA_IGNORE = ".contextignore"


class UsageError(ValueError):
    """A path that cannot be scanned."""


@dataclass(frozen=True)
class Limits:
    max_file_bytes: int = MAX_FILE_BYTES
    max_files: int = MAX_SCAN_FILES
    max_depth: int = MAX_SCAN_DEPTH
    max_total_bytes: int = MAX_SCAN_BYTES


@dataclass
class Scan:
    files: list[str] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """files (path), skipped (path, reason), warnings (message)."""
        return (
            spark.createDataFrame([(p,) for p in self.files], "path string"),
            spark.createDataFrame(self.skipped, "path string, reason string"),
            spark.createDataFrame([(w,) for w in self.warnings], "message string"),
        )


def resolve_root(path: str) -> str:
    """Real path of a directory."""
    real = os.path.realpath(path)
    if not os.path.exists(real):
        raise UsageError(f"the repository does not exist or is not accessible: {path}")
    if not os.path.isdir(real):
        raise UsageError(f"the repository is not a directory: {path}")
    return real


def to_repo_path(root: str, absolute: str) -> str:
    """Path below root with '/' separators; refuses what lies outside."""
    rel = os.path.relpath(absolute, root)
    if rel in (".", "..") or rel.startswith(f"..{os.sep}") or os.path.isabs(rel):
        raise UsageError(f"path is not inside the repository root: {absolute}")
    return rel.replace(os.sep, "/")


def name_skip_reason(name: str, path: str) -> str | None:
    if SECRETS.ignores(path):
        return "secret"
    if name in LOCKFILES:
        return "lockfile"
    return "minified" if MINIFIED.search(name) else None


def sniff(path: str) -> str | None:
    """binary where the first bytes hold a NUL, unreadable where they cannot be read."""
    try:
        with open(path, "rb") as f:
            return "binary" if b"\0" in f.read(SNIFF_BYTES) else None
    except OSError:
        return "unreadable"


def _read_rules(path: str, most: int) -> Matcher:
    if os.stat(path).st_size > most:
        raise UsageError(f"{path} is larger than {most} bytes; refusing to scan")  # dropping its rules would un-ignore files
    with open(path, encoding="utf-8", errors="replace") as f:
        return Matcher.of(f.read())


class _Walk:
    def __init__(self, root: str, limits: Limits, extra: str) -> None:
        self.root, self.limits, self.extra_name = root, limits, extra
        self.scan, self.total, self.stopped, self.too_deep = Scan(), 0, False, None
        self.extra = Matcher()

    def directory(self, at: str, inherited: list[tuple[str, Matcher]]) -> None:
        try:
            entries = sorted(os.scandir(os.path.join(self.root, at)), key=lambda e: e.name)
        except OSError:
            self.scan.skipped.append((f"{at}/", "unreadable"))
            return
        plain = {e.name for e in entries if e.is_file(follow_symlinks=False)}
        rules = inherited
        if ".gitignore" in plain:
            rules = [*inherited, (at, _read_rules(os.path.join(self.root, at, ".gitignore"), self.limits.max_file_bytes))]
        if not at and self.extra_name in plain:
            self.extra = _read_rules(os.path.join(self.root, self.extra_name), self.limits.max_file_bytes)
        for e in entries:
            if self.stopped:
                return
            path = f"{at}/{e.name}" if at else e.name
            if e.is_symlink():
                self._link(at, path)
            elif e.is_dir(follow_symlinks=False):
                self._enter(e.name, path, rules)
            elif e.name == ".git":
                self.scan.skipped.append((path, "dependency-or-build-directory"))
            elif e.is_file(follow_symlinks=False):
                self._file(e.name, path, rules)

    def _link(self, at: str, path: str) -> None:
        full = os.path.join(self.root, path)
        real = os.path.realpath(full)
        if not os.path.exists(real):
            self.scan.skipped.append((path, "unreadable"))
            return
        here, directory = os.path.join(self.root, at).rstrip("/"), os.path.isdir(real)
        inside = lambda top, p: p == top or p.startswith(f"{top}/")
        reason = "symlink-outside-repository" if not inside(self.root, real) else "symlink-loop" if directory and inside(real, here) else "symlink"
        self.scan.skipped.append((f"{path}/" if directory else path, reason))

    def _enter(self, name: str, path: str, rules: list[tuple[str, Matcher]]) -> None:
        if name in SKIPPED_DIRECTORIES:
            reason = "dependency-or-build-directory"
        elif SECRETS.ignores(path):
            reason = "secret"
        elif is_ignored(rules, f"{path}/"):
            reason = "gitignored"
        elif self.extra.ignores(f"{path}/"):
            reason = "extra-ignored"
        elif path.count("/") + 1 > self.limits.max_depth:
            self.too_deep = self.too_deep or path
            return
        else:
            self.directory(path, rules)
            return
        self.scan.skipped.append((f"{path}/", reason))

    def _file(self, name: str, path: str, rules: list[tuple[str, Matcher]]) -> None:
        full, size = os.path.join(self.root, path), None
        reason = name_skip_reason(name, path) or ("gitignored" if is_ignored(rules, path) else "extra-ignored" if self.extra.ignores(path) else None)
        if reason is None:
            try:
                size = os.stat(full).st_size
                reason = "too-large" if size > self.limits.max_file_bytes else sniff(full)
            except OSError:
                reason = "unreadable"
        if reason:
            self.scan.skipped.append((path, reason))
        elif len(self.scan.files) >= self.limits.max_files:
            self._stop(f"Scan stopped at {self.limits.max_files} files; the rest were not scanned.")
        elif self.total + size > self.limits.max_total_bytes:
            self._stop(f"Scan stopped at {self.limits.max_total_bytes} bytes of source; the rest was not scanned.")
        else:
            self.total += size
            self.scan.files.append(path)

    def _stop(self, message: str) -> None:
        self.stopped = True
        self.scan.warnings.append(message)


def scan_repository(root: str, limits: Limits | None = None, extra_ignore: str = EXTRA_IGNORE) -> Scan:
    """Eligible files, what was skipped and why, and what cut the scan short; all sorted by path."""
    walk = _Walk(resolve_root(root), limits or Limits(), extra_ignore)
    walk.directory("", [])
    if walk.too_deep:
        walk.scan.warnings.append(f"Directories nested deeper than {walk.limits.max_depth} levels were not scanned (first: {walk.too_deep}/).")
    walk.scan.files.sort()
    walk.scan.skipped.sort()
    return walk.scan
