"""Import and test edges between chunks, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import text as T
from seamline.lineage import cut

# Fixed values.
RANK = {"exact": 0, "heuristic": 1, "unresolved": 2}
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".json"]
EMITTED = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
IDENTIFIER = r"^[\p{L}_$][\p{L}\p{N}_$]*$"
EDGE_COLUMNS = ["kind", "from_id", "from_file", "to_id", "to_file", "name", "specifier", "confidence", "evidence"]


def evidence_rank(confidence: Column) -> Column:
    return reduce(lambda c, kv: c.when(confidence == kv[0], kv[1]), RANK.items(), F.when(F.lit(False), 9)).otherwise(9)


def references(chunks: DataFrame) -> DataFrame:
    """One row for each reference of each chunk, with whether the chunk is the first of its file."""
    first = chunks.groupBy("file").agg(F.min_by("id", F.struct("start_line", "id")).alias("first_id"))
    rows = chunks.select("id", "file", "language", "start_line", "end_line", "content", F.posexplode("references").alias("ref_pos", "ref"))
    return rows.join(first, "file").withColumn("is_first", F.col("id") == F.col("first_id"))


def _name(c: Column) -> Column:
    return c.rlike(IDENTIFIER) & (c != "default")


def owned_references(chunks: DataFrame) -> DataFrame:
    """References with the chunks that own them: the range that holds the line, or the chunks that
    mention the bound name; what no chunk claims belongs to the first chunk of the file."""
    rows = references(chunks)
    binding = F.coalesce(F.col("ref.local"), F.col("ref.name"))
    inside = (F.col("ref.line") >= F.col("start_line")) & (F.col("ref.line") <= F.col("end_line"))
    mentioned = F.array_contains(F.regexp_extract_all("content", F.lit(r"([\p{L}\p{N}_$]+)"), 1), binding)
    owns = F.when(inside, True).when(_name(binding), mentioned).otherwise(F.col("is_first"))
    key = F.concat_ws("|", "ref.kind", F.col("ref.line").cast("string"), "ref.name", F.coalesce("ref.specifier", F.lit("")))
    judged = rows.withColumn("owns", owns).withColumn("ref_key", key).drop("content")
    claimed = judged.where("owns").select("file", "ref_key").distinct()
    unclaimed = judged.where("not owns and is_first").join(claimed, ["file", "ref_key"], "left_anti")
    return judged.where("owns").unionByName(unclaimed).drop("ref_key")


def ecmascript_target(file: Column, specifier: Column) -> Column:
    return T.normalize_path(F.concat_ws("/", F.when(T.directory_of(file) != "", T.directory_of(file)), specifier))


def _struct(path: Column, via: Column, module: bool = False) -> Column:
    return F.struct(path.alias("path"), via.alias("via"), F.lit(module).alias("module"))


def ecmascript_candidates(target: Column, ext: Column) -> Column:
    """Files that a relative specifier's target may mean, best first."""
    stripped = target.substr(F.lit(1), F.length(target) - F.length(ext))
    sources = F.create_map(*(x for e, to in EMITTED.items() for x in (F.lit(e), F.array(*map(F.lit, to)))))
    mapped = F.transform(F.coalesce(F.try_element_at(sources, ext), F.array().cast("array<string>")), lambda s: _struct(F.concat(stripped, s), F.concat(ext, F.lit(" specifier mapped to "), s, F.lit(" source"))))
    every = F.array(*map(F.lit, EXTENSIONS))
    appended = F.transform(every, lambda e: _struct(F.concat(target, e), F.concat(F.lit("extension "), e, F.lit(" appended"))))
    index = F.transform(every, lambda e: _struct(F.concat(F.when(target != "", F.concat(target, F.lit("/"))).otherwise(""), F.lit("index"), e), F.lit("index file")))
    return F.concat(F.array(_struct(target, F.lit("exact path"))), mapped, appended, index)


def python_bases(file: Column, specifier: Column, name: Column) -> Column:
    """array of (base path, whether it names a module of its own, whether only a package counts) that
    a specifier may mean, best first; `from . import x` tries the module x first."""
    dots, dotted = F.regexp_extract(specifier, r"^(\.*)", 1), F.replace(F.regexp_extract(specifier, r"^\.*(.*)$", 1), F.lit("."), F.lit("/"))
    up = F.concat(F.when(T.directory_of(file) != "", F.concat(T.directory_of(file), F.lit("/"))).otherwise(""), F.repeat(F.lit("../"), F.greatest(F.length(dots) - 1, F.lit(0))))
    item = lambda base, own, package: F.struct(base.alias("base"), own.alias("own"), package.alias("package"))
    no = F.lit(False)
    relative = F.array(item(F.concat(up, name), (dotted == "") & name.rlike(IDENTIFIER), no), item(F.concat(up, dotted), no, dotted == ""))
    absolute = F.array(item(dotted, no, no), item(F.concat(T.top_level_of(file), F.lit("/"), dotted), no, no))
    found = F.when(dots != "", F.filter(relative, lambda b: b["own"] | (b["base"] == F.concat(up, dotted)))).otherwise(F.filter(absolute, lambda b: (b["base"] == dotted) | (F.instr(file, "/") > 0)))
    return F.transform(found, lambda b: item(T.normalize_path(b["base"]), b["own"], b["package"]))


def python_candidates(bases: Column) -> Column:
    init = lambda b: F.concat(F.when(b["base"] != "", F.concat(b["base"], F.lit("/"))).otherwise(""), F.lit("__init__.py"))
    both = F.transform(bases, lambda b: F.array(F.struct(F.when(~b["package"], F.concat(b["base"], F.lit(".py"))).alias("path"), F.lit("module file").alias("via"), b["own"].alias("module")), F.struct(init(b).alias("path"), F.lit("package __init__").alias("via"), b["own"].alias("module"))))
    return F.filter(F.flatten(both), lambda c: c["path"].isNotNull())


def resolve_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds to_file, via, module and unresolved (why not) to rows with id, ref_pos, file, language, ref; `files` is (file)."""
    spec, ecma, python = F.col("ref.specifier"), F.col("language").isin("typescript", "javascript"), F.col("language") == "python"
    relative = spec.rlike(r"^\.\.?(/|$)")
    # one step a column, so that no expression is repeated inside another
    rows = refs.withColumn("_target", F.when(ecma & relative, ecmascript_target(F.col("file"), spec)))
    rows = rows.withColumn("_ext", T.extension_of("_target")).withColumn("_bases", F.when(python, python_bases(F.col("file"), spec, F.col("ref.name"))))
    rows = rows.withColumn("candidates", F.when(F.col("_target").isNotNull(), ecmascript_candidates(F.col("_target"), F.col("_ext"))).when(python, python_candidates(F.col("_bases"))))
    exploded = rows.select("id", "ref_pos", F.posexplode("candidates").alias("pos", "c")).select("id", "ref_pos", "pos", F.col("c.path").alias("path"), F.col("c.via").alias("via"), F.col("c.module").alias("module"))
    known = files.select(F.col("file").alias("path"))
    hit = exploded.join(known, "path").groupBy("id", "ref_pos").agg(F.min_by(F.struct("path", "via", "module"), "pos").alias("hit"))
    first = F.get("candidates", F.lit(0))["path"]
    why = (
        F.when(spec.isNull(), F.when(F.col("ref.kind") == "import", "dynamic specifier").otherwise("no target"))
        .when(ecma & ~relative, F.when(spec.rlike(r"^(@/|~|#)"), "path alias or bare specifier not resolved").otherwise("bare package specifier"))
        .when(first.startswith("../") | (first == ".."), "escapes the repository root")
        .when(python & ~spec.startswith("."), F.concat(F.lit('no local module for "'), spec, F.lit('" (external packages are not resolved)')))
        .when(ecma | python, F.concat(F.lit("no such file in the scanned repository: "), first))
        .otherwise(F.concat(F.lit("import resolution is not supported for "), F.col("language")))
    )
    return rows.join(hit, ["id", "ref_pos"], "left").withColumns({"to_file": F.col("hit.path"), "via": F.col("hit.via"), "module": F.col("hit.module"), "unresolved": F.when(F.col("hit").isNull(), why)}).drop("candidates", "hit", "_target", "_ext", "_bases")


def import_edges(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One edge for each owned reference; what cannot be resolved is an edge without a target."""
    found = resolve_imports(owned_references(chunks), files if files is not None else chunks.select("file").distinct())
    wanted = F.when(_name(F.col("ref.name")) & ~F.coalesce(F.col("ref.namespace"), F.lit(False)) & ~F.coalesce(F.col("module"), F.lit(False)), F.col("ref.name"))
    named = chunks.where("name is not null").groupBy(F.col("file").alias("to_file"), F.col("name").alias("symbol")).agg(F.min_by("id", F.struct("start_line", "id")).alias("symbol_id"))
    own = chunks.select(F.col("id").alias("given_id"), F.col("file").alias("given_file"))
    rows = found.withColumn("symbol", wanted).join(named, ["to_file", "symbol"], "left").withColumn("given_id", F.col("ref.target_chunk_id")).join(own, "given_id", "left")
    given, hit = F.col("given_id").isNotNull(), F.col("symbol_id").isNotNull()
    said = F.concat(F.lit('import "'), F.col("ref.specifier"), F.lit('" resolved to '), F.col("to_file"), F.concat(F.lit(" ("), F.col("via"), F.lit(")")))
    return rows.select(
        F.col("ref.kind").alias("kind"),
        F.col("id").alias("from_id"),
        F.col("file").alias("from_file"),
        F.coalesce("given_id", "symbol_id").alias("to_id"),
        F.when(given, F.col("given_file")).otherwise(F.col("to_file")).alias("to_file"),
        F.col("ref.name").alias("name"),
        F.col("ref.specifier").alias("specifier"),
        F.when(given, F.coalesce("ref.evidence", F.lit("heuristic"))).when(hit, "exact").when(F.col("to_file").isNotNull(), "heuristic").otherwise("unresolved").alias("confidence"),
        F.when(given, "target chunk set by the analyzer")
        .when(F.col("to_file").isNull(), F.col("unresolved"))
        .when(hit, F.concat(said, F.lit("; "), F.col("ref.name"), F.lit(" is a chunk there")))
        .when(F.col("symbol").isNotNull(), F.concat(said, F.lit("; no chunk named "), F.col("ref.name"), F.lit(" there")))
        .otherwise(F.concat(said, F.lit("; a whole-module import")))
        .alias("evidence"),
    )


def tested_stem(path: Column) -> Column:
    base = T.base_name(path)
    stem = base.substr(F.lit(1), F.length(base) - F.length(T.extension_of(path)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, r"\.(test|spec)$", ""), "^test_", ""), "_test$", "")


def shared_directories(a: Column, b: Column) -> Column:
    """Leading directories that two paths share."""
    x, y = (F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1) for p in (a, b))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])


def test_edges(chunks: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges from a test file's first chunk to what it tests: what it imports, else files of the same
    stem and language family that share the most directories, ties kept."""
    family = F.when(F.col("language").isin("typescript", "javascript"), "ecmascript").otherwise(F.col("language"))
    files = chunks.groupBy("file").agg(F.min_by("id", F.struct("start_line", "id")).alias("anchor"), F.min_by(family, F.struct("start_line", "id")).alias("family"))
    tests = files.where(T.is_test_file("file")).select(F.col("file").alias("from_file"), "anchor", "family", tested_stem(F.col("file")).alias("stem"))
    base = T.base_name("file")
    sources = files.where(~T.is_test_file("file")).select(F.col("file").alias("to_file"), "family", base.substr(F.lit(1), F.length(base) - F.length(T.extension_of("file"))).alias("stem"))
    imported = imports.where(F.col("to_file").isNotNull() & ~T.is_test_file("to_file")).select("from_file", "to_file").distinct()
    exact = tests.join(imported, "from_file").select("from_file", "anchor", "to_file", F.lit("exact").alias("confidence"), F.concat(F.lit("test file "), "from_file", F.lit(" imports "), "to_file").alias("evidence"))
    named = tests.join(sources, ["stem", "family"])
    by_import = named.join(imported, ["from_file", "to_file"], "left_semi").select("from_file").distinct()
    near = Window.partitionBy("from_file").orderBy(F.col("shared").desc())
    best = named.join(by_import, "from_file", "left_anti").withColumn("shared", shared_directories(F.col("from_file"), F.col("to_file"))).withColumn("place", F.rank().over(near)).where("place = 1")
    tied = best.withColumn("n", F.count("*").over(Window.partitionBy("from_file")))
    note = F.when(F.col("n") > 1, F.concat(F.lit("; ambiguous, "), F.col("n").cast("string"), F.lit(" files share the name"))).otherwise("")
    guess = tied.select("from_file", "anchor", "to_file", F.lit("heuristic").alias("confidence"), F.concat(F.lit("test file naming convention: "), "from_file", F.lit(" <-> "), "to_file", note).alias("evidence"))
    both = exact.unionByName(guess)
    return both.select(F.lit("test").alias("kind"), F.col("anchor").alias("from_id"), "from_file", F.lit(None).cast("string").alias("to_id"), "to_file", F.col("to_file").alias("name"), F.lit(None).cast("string").alias("specifier"), "confidence", "evidence")


def build_edges(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All edges, EDGE_COLUMNS. Chunks are read often here, so a splitter that makes them runs once."""
    chunks = cut(chunks)
    imports = cut(import_edges(chunks, files))
    return imports.unionByName(test_edges(chunks, imports)).select(*EDGE_COLUMNS)


def edge_order(edges: DataFrame, chunks: DataFrame) -> list[Column]:
    """Total order of edges, by where they start and then by content; plain string order."""
    return [F.col("from_file"), F.col("from_start"), F.col("from_id"), F.col("kind"), F.col("name"), F.coalesce("specifier", F.lit("")), F.coalesce("to_id", F.lit("")), F.coalesce("to_file", F.lit("")), F.col("confidence"), F.col("evidence")]


def best_edges(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first edge of each key; WindowGroupLimit keeps one row a key before the shuffle."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")


def neighbors(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, other, confidence, evidence, place: chunks one edge away in either direction, best edge
    kept (outgoing before incoming on ties), exact ones first, then by location."""
    start = chunks.select(F.col("id").alias("from_id"), F.col("start_line").alias("from_start"))
    usable = edges.where("to_id is not null and confidence <> 'unresolved' and to_id <> from_id").join(start, "from_id")
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(edge_order(edges, chunks))))
    out = usable.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "confidence", "evidence", F.lit(0).alias("direction"), key.alias("key"))
    back = usable.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "confidence", "evidence", F.lit(1).alias("direction"), key.alias("key"))
    best = best_edges(out.unionByName(back), ["id", "other"], [evidence_rank(F.col("confidence")), F.col("direction"), F.col("key")])
    placed = best.join(chunks.select(F.col("id").alias("other"), F.col("file").alias("other_file"), F.col("start_line").alias("other_start")), "other")
    order = Window.partitionBy("id").orderBy(evidence_rank(F.col("confidence")), "other_file", "other_start", "other")
    return placed.select("id", "other", "confidence", "evidence", F.row_number().over(order).alias("place"))


def file_imports(edges: DataFrame) -> DataFrame:
    """from_file, to_file, confidence, evidence: best import of each file by each file."""
    rows = edges.where("kind <> 'test' and to_file is not null and to_file <> from_file")
    return best_edges(rows, ["from_file", "to_file"], [evidence_rank(F.col("confidence")), F.col("from_id"), F.col("name"), F.col("evidence")]).select("from_file", "to_file", "confidence", "evidence")


def tests_for(edges: DataFrame) -> DataFrame:
    """file, tests: sorted test files of each source file."""
    return edges.where("kind = 'test'").groupBy(F.col("to_file").alias("file")).agg(F.array_sort(F.collect_set("from_file")).alias("tests"))


def sources_for(edges: DataFrame) -> DataFrame:
    """file, sources: sorted source files of each test file."""
    return edges.where("kind = 'test'").groupBy(F.col("from_file").alias("file")).agg(F.array_sort(F.collect_set("to_file")).alias("sources"))


def linked_files(edges: DataFrame) -> DataFrame:
    """file, linked, side: tests of a source (0) and sources of a test (1)."""
    links = edges.where("kind = 'test'").select("from_file", "to_file").distinct()
    return links.select(F.col("to_file").alias("file"), F.col("from_file").alias("linked"), F.lit(0).alias("side")).unionByName(links.select(F.col("from_file").alias("file"), F.col("to_file").alias("linked"), F.lit(1).alias("side")))
