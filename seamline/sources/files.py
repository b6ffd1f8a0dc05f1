"""Classification and redaction of source files, as columns."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import text as T

# Language, strategy, extensions, base names, interpreters.
FILE_TYPES = [
    ("typescript", "semantic", ".ts .tsx .mts .cts", "", "ts-node tsx"),
    ("javascript", "semantic", ".js .jsx .mjs .cjs", "", "node nodejs bun deno"),
    ("python", "semantic", ".py .pyi", "", "python"),
    ("sql", "structural", ".sql", "", ""),
    ("html", "structural", ".html .htm", "", ""),
    ("css", "structural", ".css", "", ""),
    ("scss", "structural", ".scss", "", ""),
    ("json", "structural", ".json .jsonc", "", ""),
    ("yaml", "structural", ".yaml .yml", "", ""),
    ("toml", "structural", ".toml", "", ""),
    ("markdown", "structural", ".md .markdown", "", ""),
    ("go", "text", ".go", "", ""),
    ("java", "text", ".java", "", ""),
    ("rust", "text", ".rs", "", ""),
    (
        "text",
        "text",
        ".txt .rst .adoc .csv .tsv .log .ini .cfg .conf .properties .xml .svg .sh .bash .zsh .fish .rb .php .pl .lua .r .c .h .cc .cpp .hpp .cs .kt .kts .scala .swift .m .dart .ex .exs .erl .hs .clj .vue .svelte .less .graphql .gql .proto .tf .gradle .cmake .mk",
        "dockerfile makefile gnumakefile rakefile gemfile procfile justfile readme license licence copying notice authors contributors changelog codeowners .gitignore .gitattributes .dockerignore .editorconfig .npmrc .nvmrc .prettierignore .eslintignore",
        "sh bash zsh dash ksh fish ruby perl php lua awk",
    ),
]
NOT_TEXT = r"[\x00-\x08\x0E-\x1F\uFFFD]"
HEAD_CHARS = 1024
PLACEHOLDER = "[REDACTED]"
#: Credential shapes of one line.
SHAPES = [
    r"\b(?:sk|pk|rk)[-_](?:live|test|proj|ant)?[-_]?[A-Za-z0-9_-]{20,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
]
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
#: A quoted literal assigned to a credential-like name; the prefix and the closing quote are groups,
#: which avoids a look-behind of unbounded length.
ASSIGNED = r"""(?i)((?:api[_-]?key|secret|token|passw(?:or)?d|credential)s?["']?\s*(?::\s*[\w<>\[\]| ]+?\s*)?[:=]\s*["'`])[^"'`\n]{8,}(["'`])"""


@cache
def lookup(field: int) -> dict[str, tuple[str, str]]:
    return {key: (row[0], row[1]) for row in FILE_TYPES for key in row[field].split()}


def _typed(field: int, key: Column) -> Column:
    """struct(language, strategy) of a key, null where unknown."""
    entries = [x for k, (lang, strategy) in lookup(field).items() for x in (F.lit(k), F.struct(F.lit(lang).alias("language"), F.lit(strategy).alias("strategy")))]
    return F.try_element_at(F.create_map(*entries), key)


def interpreter_of(head: Column) -> Column:
    """Interpreter of a #! line, with env and version suffixes resolved; null without one."""
    line = F.regexp_extract(F.regexp_replace(head, r"^\uFEFF", ""), r"^([^\r\n]*)", 1)
    words = F.split(F.trim(F.regexp_replace(line, "^#!", "")), r"\s+")
    command = T.base_name(F.get(words, F.lit(0)))
    after = F.filter(F.slice(words, 2, 1000), lambda w: ~w.startswith("-") & ~w.contains("="))
    resolved = F.when(command == "env", F.coalesce(F.get(after, F.lit(0)), F.lit(""))).otherwise(command)
    name = F.regexp_replace(T.base_name(resolved), r"[\d.]+$", "")
    return F.when(line.startswith("#!") & (name != ""), name)


def classify(path: Column, head: Column) -> Column:
    """struct(language, strategy, reason): by extension, else base name, else shebang, else by what
    the head looks like; language is null and strategy `skip` for what is not text."""
    base, ext = T.base_name(path), F.lower(T.extension_of(path))
    known = F.length(ext) > 1
    shebang = interpreter_of(head)
    what = F.when(known, F.concat(F.lit("unknown extension "), ext)).otherwise("no extension")

    def out(kind: Column, reason: Column) -> Column:
        return F.struct(kind["language"].alias("language"), kind["strategy"].alias("strategy"), reason.alias("reason"))

    plain = F.struct(F.lit("text").alias("language"), F.lit("text").alias("strategy"))
    skip = F.struct(F.lit(None).cast("string").alias("language"), F.lit("skip").alias("strategy"))
    by_ext, by_name, by_bang = _typed(2, ext), _typed(3, F.lower(base)), _typed(4, shebang)
    return (
        F.when(known & by_ext.isNotNull(), out(by_ext, F.concat(F.lit("extension "), ext)))
        .when(by_name.isNotNull(), out(by_name, F.concat(F.lit("well-known file name "), base)))
        .when(by_bang.isNotNull(), out(by_bang, F.concat(F.lit("shebang "), shebang)))
        .when(shebang.isNotNull(), out(plain, F.concat(F.lit("script with shebang "), shebang)))
        .when(head.isNull(), out(skip, F.concat(what, F.lit(", content not available to check"))))
        .when(head.rlike(NOT_TEXT), out(skip, F.concat(what, F.lit(", content is not text"))))
        .otherwise(out(plain, F.concat(what, F.lit(", content looks like text"))))
    )


def redact(source: Column) -> Column:
    """Credential-like text as a placeholder; the number of lines stays."""
    # keys may span lines: split around them and put their line breaks back
    keys = F.regexp_extract_all(source, F.lit(f"({PRIVATE_KEY})"), 1)
    rest = F.split(source, PRIVATE_KEY, -1)
    marks = F.concat(F.transform(keys, lambda k: F.concat(F.lit(PLACEHOLDER), F.repeat(F.lit("\n"), F.length(k) - F.length(F.replace(k, F.lit("\n"), F.lit("")))))), F.array(F.lit("")))
    out = F.when(F.size(keys) > 0, F.array_join(F.zip_with(rest, marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(source)
    for shape in SHAPES:
        out = F.regexp_replace(out, shape, PLACEHOLDER.replace("[", r"\[").replace("]", r"\]"))
    return F.regexp_replace(out, ASSIGNED, f"$1{PLACEHOLDER}$2")


def source_files(raw: DataFrame) -> DataFrame:
    """path, source, language, strategy, reason, size of (path, content binary) rows: NUL bytes
    anywhere mark binary files, which go; the rest is classified by its first HEAD_CHARS and redacted."""
    text = raw.where(~F.decode("content", "ISO-8859-1").contains("\x00"))
    decoded = text.select("path", F.expr("decode(content, 'UTF-8')").alias("text"), F.length("content").cast("long").alias("size"))
    typed = decoded.withColumn("type", classify(F.col("path"), F.substring("text", 1, HEAD_CHARS))).where("type.language is not null")
    return typed.select("path", redact(F.col("text")).alias("source"), "type.language", "type.strategy", "type.reason", "size")


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, content) of files below root, read by the executors from storage they share."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    rows = spark.read.format("binaryFile").load([f"{root}/{p}" for p in paths])
    top = root.rstrip("/")
    return rows.select(F.expr("substring(path, locate(top, path) + length(top) + 1)".replace("top", "'" + top.replace("'", "\\'") + "'")).alias("path"), "content")
