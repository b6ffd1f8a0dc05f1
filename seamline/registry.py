"""Queries of the retrieval engine over the driver's tables, and the SQL that checks them.

Documents are chunks (one a document, file source/lang/id.txt), benchmark texts are tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamline.config import RetrievalConfig
from seamline.functions import text as T
from seamline.lineage import cut
from seamline.operators import evaluate as E
from seamline.operators import graph as G
from seamline.operators import index as ix
from seamline.operators import rank as R
from seamline.operators import score as S
from seamline.operators import select as L
from seamline.operators.split import split_files
from seamline.plans import engine
from seamline.plans.evaluation import line_weights
from seamline.schemas import CHUNK
from seamline.sources import files as sources


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_file() -> F.Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CHUNK rows."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        doc_file().alias("file"),
        F.lit("text").alias("language"),
        F.lit("file").alias("kind"),
        F.lit(None).cast("string").alias("name"),
        F.lit(1).alias("start_line"),
        F.size(F.split(text, "\n", -1)).alias("end_line"),
        text.alias("content"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("string").alias("container_name"),
    )
    empty = spark.createDataFrame([], CHUNK).schema["references"].dataType
    return rows.withColumn("references", F.array().cast(empty))


def benchmark_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, term: tokens of each benchmark text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.explode(T.tokenize("text")).alias("term"))


def tokenize_documents(spark, sf_dir):
    toks = T.tokenize(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(toks).alias("n_tokens"), F.md5(F.array_join(toks, " ").cast("binary")).alias("digest"))


def stem_vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.split_identifier("text")).alias("word")).distinct()
    return words.select("word", T.stem("word").alias("stem"))


def term_frequency(spark, sf_dir):
    found = ix.postings(doc_chunks(spark, sf_dir))
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def doc_length_stats(spark, sf_dir):
    return ix.text_stats(doc_chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_scores(spark, sf_dir):
    scores = ix.bm25(doc_chunks(spark, sf_dir), benchmark_query(spark, sf_dir))
    return scores.select("task_id", "chunk_id", F.round("score", 6).alias("score"))


def bm25_top10(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    place = chunks.select(F.col("id").alias("chunk_id"), "file", "start_line")
    scores = ix.bm25(chunks, benchmark_query(spark, sf_dir)).select("task_id", "chunk_id", F.round("score", 6).alias("total"))
    return S.top_k(scores.join(place, "chunk_id"), 10, [F.col("total").desc(), F.col("file"), F.col("chunk_id")]).select("task_id", "chunk_id", "total", "rank")


def lexical_normalized(spark, sf_dir):
    terms = benchmark_query(spark, sf_dir).groupBy("task_id").agg(F.collect_set("term").alias("words")).withColumn("related", F.array().cast("array<string>"))
    return S.lexical_signals(terms, doc_chunks(spark, sf_dir)).select("task_id", "chunk_id", F.round("lexical", 6).alias("lexical"))


def part_terms(spark, sf_dir):
    """One task for each brand: the stems of its parts' types and names, and the names of its large parts as exact terms."""
    parts = table(spark, sf_dir, "part")
    words = parts.select(F.col("p_brand").alias("task_id"), F.explode(T.tokenize(F.concat_ws(" ", "p_type", "p_name"))).alias("w"))
    large = F.when(F.col("p_size") >= 45, F.col("p_name"))
    exact = parts.groupBy(F.col("p_brand").alias("task_id")).agg(F.array_sort(F.collect_set(large)).alias("exact"))
    none = F.array().cast("array<string>")
    return words.groupBy("task_id").agg(F.array_sort(F.collect_set("w")).alias("words")).join(exact, "task_id").withColumns({"variants": none, "related": none, "mentions_tests": F.lit(False)})


def part_chunks(spark, sf_dir):
    """Distinct part names as named chunks."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").cast("string").alias("id"))
    return names.select("id", F.col("p_name").alias("name"))


def partial_name_score(spark, sf_dir):
    """Names that share a stem with a task, by an equality join on stems."""
    chunks, terms = part_chunks(spark, sf_dir), part_terms(spark, sf_dir)
    met = terms.select("task_id", F.explode("words").alias("word")).join(ix.symbol_words(chunks), "word").select("task_id", F.col("chunk_id").alias("id")).distinct()
    named = met.join(chunks, "id").join(terms.select("task_id", "words"), "task_id")
    scored = named.select("task_id", F.col("id").alias("chunk_id"), F.round(S.partial_name_score(F.col("name"), F.col("words")), 6).alias("score"))
    return scored.where("score > 0")


def exact_key_join(spark, sf_dir):
    keys = part_terms(spark, sf_dir).select("task_id", F.explode("exact").alias("term")).select("task_id", F.explode(T.exact_keys("term")).alias("key"))
    return keys.join(ix.symbol_keys(part_chunks(spark, sf_dir)), "key").select("task_id", "chunk_id").distinct()


def symbol_signal(spark, sf_dir):
    return S.symbol_signals(part_terms(spark, sf_dir), part_chunks(spark, sf_dir)).select("task_id", "chunk_id", F.round("symbol", 6).alias("symbol"))


def page_files(spark, sf_dir):
    """Page paths without host and query."""
    path = F.regexp_extract("url", r"^\w+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(path.alias("file")).distinct()


def page_terms(spark, sf_dir):
    """One task for each host: words of the host's name; exact terms are suffixes and base names of all its files."""
    host, last = F.split_part("file", F.lit("/"), F.lit(1)), T.base_name("file")
    none = F.array().cast("array<string>")
    by_host = page_files(spark, sf_dir).groupBy(host.alias("task_id")).agg(F.collect_set(last).alias("last"), F.collect_set(F.concat_ws("/", F.split_part("file", F.lit("/"), F.lit(2)), last)).alias("tail"))
    return by_host.select("task_id", F.array_distinct(T.tokenize("task_id")).alias("words"), F.array_sort(F.array_union("tail", "last")).alias("exact"), none.alias("variants"), none.alias("related"), F.lit(False).alias("mentions_tests"))


def path_signal(spark, sf_dir):
    return S.path_signals(page_terms(spark, sf_dir), page_files(spark, sf_dir)).select("task_id", "file", F.round("path", 6).alias("path"))


def suffix_match(spark, sf_dir):
    said = page_terms(spark, sf_dir).select("task_id", F.explode("exact").alias("suffix")).distinct()
    return said.join(ix.path_suffixes(page_files(spark, sf_dir)), "suffix").select("task_id", "suffix", "file")


def proximity_signal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", doc_file().alias("file"))
    best = docs.groupBy("lang").agg(F.min_by("file", "doc_id").alias("best"))
    return docs.join(F.broadcast(best), "lang").select("doc_id", R.proximity(F.col("file"), F.col("best")).alias("proximity"))


def weighted_total_topk(spark, sf_dir):
    """Weighted signals made of table columns, forty best of each language."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("task_id"), F.col("doc_id").cast("string").alias("chunk_id"), doc_file().alias("file"), F.lit(1).alias("start_line"), F.pmod("doc_id", F.lit(10)).alias("a"), F.pmod("n_chars", F.lit(100)).alias("b"))
    signals = docs.withColumns({"symbol": F.col("a") / 10, "lexical": F.col("b") / 100, "path": F.col("a") / 20, "dependency": F.lit(0.0), "test": F.lit(1.0), "proximity": F.col("b") / 200})
    totals = signals.withColumn("total", F.round(S.total(RetrievalConfig().weights), 9))
    return S.top_k(totals, 40, [F.col("total").desc(), F.col("file")]).select("task_id", "chunk_id", F.round("total", 6).alias("total"), "rank")


def orders_edges(spark, sf_dir):
    """Customers buy from suppliers: edges whose confidence is the line's return flag."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    confidence = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "heuristic").otherwise("unresolved")
    return lines.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to_id"), confidence.alias("confidence"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"))


def best_edge_per_pair(spark, sf_dir):
    best = G.best_edges(orders_edges(spark, sf_dir), ["from_id", "to_id"], [G.evidence_rank(F.col("confidence")), F.col("ord"), F.col("line")])
    return best.select("from_id", "to_id", "confidence", "ord", "line")


def one_hop_neighbors(spark, sf_dir):
    """Nodes one usable edge away, in either direction, with the best confidence."""
    e = orders_edges(spark, sf_dir).where("confidence <> 'unresolved'")
    both = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "confidence").unionByName(e.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "confidence"))
    return both.groupBy("id", "other").agg(F.min_by("confidence", G.evidence_rank(F.col("confidence"))).alias("confidence"))


def expansion_capped(spark, sf_dir):
    """Five suppliers a nation take at most four customers each and ten in all."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("task_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed_id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("seed_rank")).where("seed_rank <= 5")
    near = one_hop_neighbors(spark, sf_dir).join(F.broadcast(suppliers), F.col("id") == F.col("seed_id"))
    place = F.struct(G.evidence_rank(F.col("confidence")).alias("r"), F.col("other").alias("o"))
    options = near.select("task_id", "seed_rank", "seed_id", place.alias("place"), F.col("other").alias("chunk_id"), F.lit("dependency").alias("relation"), "confidence", F.lit("").alias("evidence"))
    c = RetrievalConfig().expansion
    return R.capped_expansion(options, c.max_neighbors_per_seed, c.max_expanded).select("task_id", "seed_id", "chunk_id", "confidence")


def dedupe_first_by_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("t").alias("task_id"), F.concat("source", F.lit("/"), "lang").alias("file"), F.pmod("n_chars", F.lit(50)).alias("start_line"), F.pmod("n_chars", F.lit(50)).alias("end_line"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("chunk_id"), (F.pmod("doc_id", F.lit(7)) / 7).alias("total"))
    return R.dedupe_by_rank(docs).select("file", "start_line", "chunk_id", F.round("total", 6).alias("total"))


def chunk_id_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.chunk_id(doc_file(), F.lit(1), F.col("n_chars"), F.lit("file"), F.col("source")).alias("chunk_id"))


def distinct_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy(F.md5(F.col("line").cast("binary")).alias("line_hash")).agg(F.count("*").alias("n"))


def turn_ranges(spark, sf_dir):
    """A range of lines for each turn, as long as its text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("turn") * 10).alias("start_line"), (F.col("turn") * 10 + F.floor(F.length("text") / F.lit(40))).alias("end_line"))


def region_merge(spark, sf_dir):
    return L.merge_ranges(turn_ranges(spark, sf_dir), ["conv_id"], "start_line", "end_line")


def event_regions(spark, sf_dir):
    """Events of a user within a minute of each other."""
    second = F.unix_timestamp("ts")
    ranges = table(spark, sf_dir, "events").select("user_id", second.alias("s"), (second + F.floor("value")).alias("e"))
    return L.merge_ranges(ranges, ["user_id"], "s", "e")


def coverage(spark, sf_dir):
    """Assistant turns whose lines the other turns of the conversation cover by four fifths."""
    t = turn_ranges(spark, sf_dir)
    units = t.where("role = 'assistant'").select("conv_id", F.col("turn").alias("unit"), F.lit("f").alias("file"), "start_line", "end_line")
    others = t.where("role <> 'assistant'").select("conv_id", F.lit("f").alias("file"), "start_line", "end_line")
    return E.covered_units(units, others, ["conv_id"]).select("conv_id", "unit", "covered")


def cover_match(spark, sf_dir):
    t = turn_ranges(spark, sf_dir)
    units = t.where("role = 'assistant'").select("conv_id", F.lit("f").alias("file"), "start_line", "end_line")
    others = t.where("role <> 'assistant'").select("conv_id", "turn", F.lit("f").alias("file"), "start_line", "end_line")
    return E.matched_chunks(others, units, ["conv_id"]).select("conv_id", "turn")


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def recall_precision(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumns({"covered": F.col("quality") == 1, "matched": F.col("toxic") == 0})
    both = E.recall(rows, ["lang", "source"]).select("lang", "source", "recall").join(E.precision(rows, ["lang", "source"]).select("lang", "source", "precision"), ["lang", "source"])
    return both.select("lang", "source", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def macro_micro(spark, sf_dir):
    """Languages are modes, sources are splits' tasks: macro and micro means, and all splits together."""
    rows = labelled(spark, sf_dir).withColumns({"mode": F.col("lang"), "split": F.when(F.pmod("doc_id", F.lit(3)) == 0, "heldout").otherwise("tuning")})
    tasks = rows.groupBy("mode", "split", "source").agg(F.sum("quality").cast("long").alias("hit"), F.count("*").alias("total"), F.avg(1 - F.col("toxic")).alias("precision"), E.size_reduction(F.sum(F.col("quality") * F.col("n_chars")), F.sum("n_chars")).alias("size_reduction"))
    out = E.aggregate_modes(tasks.withColumn("recall", E.ratio(F.col("hit"), F.col("total"))))
    return out.select("mode", "split", "tasks", *(F.round(c, 6).alias(c) for c in ("recall_macro", "recall_micro", "precision_macro", "size_reduction_macro")))


def mode_rows(spark, sf_dir):
    """Results a task and mode: sources are tasks, English documents the judged mode, French ones the other."""
    rows = labelled(spark, sf_dir).where("lang IN ('en', 'fr')")
    split = F.when(F.length("source") % 2 == 0, "heldout").otherwise("tuning")
    return rows.groupBy(F.col("source").alias("task_id"), split.alias("split"), F.when(F.col("lang") == "en", "judged").otherwise("deterministic").alias("mode")).agg(
        F.sum("quality").cast("long").alias("hit"),
        F.count("*").alias("total"),
        F.avg("quality").alias("recall"),
        F.avg(1 - F.col("toxic")).alias("precision"),
        F.sum("n_chars").alias("selected_chars"),
        E.size_reduction(F.sum(F.col("toxic") * F.col("n_chars")), F.sum("n_chars")).alias("size_reduction"),
        F.array_sort(F.collect_set(F.pmod("n_chars", F.lit(2)))).alias("selected"),
    )


def evaluation_gates(spark, sf_dir):
    gates = E.check_gates(E.aggregate_modes(mode_rows(spark, sf_dir)))
    return gates.select("mode", "metric", "split", F.round("value", 6).alias("value"), F.round("floor", 6).alias("floor"), "passed")


def evaluation_impact(spark, sf_dir):
    rows = mode_rows(spark, sf_dir)
    pairs = E.paired_difference(rows, ["recall", "precision", "selected_chars"], "judged", "deterministic").join(rows.select("task_id", "split").distinct(), "task_id")
    return E.impact(pairs).select("split", "tasks", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "selected_chars")), "better", "same", "worse")


def evaluation_findings(spark, sf_dir):
    return E.findings(mode_rows(spark, sf_dir))


def candidate_recall(spark, sf_dir):
    """Good documents are required units of their language; documents that are not toxic are candidates."""
    rows = labelled(spark, sf_dir).select(F.col("lang").alias("task_id"), F.col("source").alias("unit"), F.col("doc_id").cast("string").alias("chunk_id"), "quality", "toxic")
    return E.candidate_recall(rows.where("quality = 1"), rows.where("toxic = 0")).select("task_id", "found", "total")


def file_weights(spark, sf_dir):
    """Lines and characters of documents as files, as the evaluation weighs them."""
    files = table(spark, sf_dir, "documents").select(doc_file().alias("path"), F.coalesce("text", F.lit("")).alias("source"))
    return line_weights(files).groupBy("file").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))


def paired_difference(spark, sf_dir):
    rows = labelled(spark, sf_dir).groupBy(F.col("source").alias("task_id"), F.col("lang").alias("mode")).agg(F.avg("quality").alias("recall"), F.avg("toxic").alias("precision"))
    return E.paired_difference(rows, ["recall", "precision"], "en", "fr").select("task_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def character_shares(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("lang", F.col("doc_id").alias("line"), F.col("n_chars").alias("chars"), (F.col("quality") == 1).alias("is_wanted"), (F.col("toxic") == 1).alias("is_irrelevant"))
    return E.character_shares(rows, ["lang"])


def spread_min_mean_max(spark, sf_dir):
    return E.spread(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", "min", F.round("mean", 6).alias("mean"), "max")


def supports_closure(spark, sf_dir):
    """Each turn's parent is the turn before: all turns above each last turn."""
    t = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("parent_id"), "conv_id", "turn")
    last = t.groupBy("conv_id").agg(F.max_by("id", "turn").alias("id"))
    return L.parent_chains(t, last).select("id", "support_id")


def threshold_sweep(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.col("lang").alias("split"), (F.pmod("n_chars", F.lit(97)) / 97).alias("score"), (F.col("quality") == 1).alias("required"))
    return E.threshold_sweep(rows).select("split", F.round("threshold", 2).alias("threshold"), "selected", "required", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def redact_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sources.redact(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


def classify_path(spark, sf_dir):
    """Files named after documents, with extensions dealt by id."""
    exts = [".ts", ".js", ".py", ".sql", ".md", ".toml", ".rs", ".weird", "", ".Dockerfile"]
    path = F.concat("source", F.lit("/f"), F.element_at(F.array(*map(F.lit, exts)), (F.pmod("doc_id", F.lit(len(exts))) + 1).cast("int")))
    head = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit("#!/usr/bin/env -S python3.12 -u")).otherwise(F.substring("text", 1, 1024))
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), sources.classify(path, head).alias("c"))
    return docs.select("doc_id", "path", "c.language", "c.strategy", "c.reason")


def text_windows(spark, sf_dir):
    """Documents as plain text files, one word a line, cut into windows."""
    files = table(spark, sf_dir, "documents").select(doc_file().alias("path"), F.regexp_replace("text", r"\s", "\n").alias("source"), F.lit("text").alias("language"))
    return split_files(files).select("id", "file", "kind", "start_line", "end_line")


def html_regions(spark, sf_dir):
    """Pages as HTML files, a tag a line: landmarks, scripts and styles."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.replace(F.col("html"), F.lit("><"), F.lit(">\n<")).alias("source"), F.lit("html").alias("language"))
    return split_files(files).select("id", "file", "kind", "name", "start_line", "end_line")


def retrieve(spark, sf_dir):
    """Shortlists of all benchmark texts over all documents, by the engine's lexical signals."""
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("task"))
    terms = cut(engine.parse_tasks(tasks))
    found = S.score_chunks(terms, doc_chunks(spark, sf_dir), RetrievalConfig())
    return S.top_k(found, RetrievalConfig().shortlist_size).select("task_id", "chunk_id", "file", "symbol", F.round("lexical", 9).alias("lexical"), "path", F.round("total", 9).alias("total"), "rank")


def customer_sources(spark, sf_dir):
    """A TypeScript file for each customer, which imports the next customer's from its own segment's
    directory; every tenth has a test file beside it."""
    k = F.col("c_custkey")
    at = F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/c"), k.cast("string"))
    code = F.format_string('import { f%d } from "./c%d.js";\nexport function f%d() {\n  return f%d();\n}\n', k + 1, k + 1, k, k + 1)
    rows = table(spark, sf_dir, "customer")
    files = rows.select(F.concat(at, F.lit(".ts")).alias("path"), code.alias("source"))
    tests = rows.where(k % 10 == 0).select(F.concat(at, F.lit(".test.ts")).alias("path"), F.format_string('test("c%d", () => {\n  run();\n});\n', k).alias("source"))
    return files.unionByName(tests).withColumn("language", F.lit("typescript"))


def source_chunks(spark, sf_dir):
    return split_files(customer_sources(spark, sf_dir)).select("id", "file", "kind", "name", "start_line", "end_line", "content")


#: A source of each format; § is a supplier's number.
TEMPLATES = {
    "md": ("markdown", "intro\n\n# A§\ntext\n## B\n```\n# no\n```\nSet\n===\ny\n"),
    "json": ("json", '{\n "a§": 1,\n "b": {"c": [1,\n2]},\n "d": 3, "e": 4\n}\n'),
    "yaml": ("yaml", "a: 1\nb:\n  - x\nc: |\n  t\n\n---\nd§: 1\n"),
    "toml": ("toml", "t = [1,\n2]\n[a.b§]\nx = 1\n\n# c\n[[p]]\ny=2\n[[p]]\ny=3\n"),
    "sql": ("sql", "-- c\ncreate table if not exists a.b§ (x int);\n\nselect * from t§ where s = ';';\nwith q as (select 1) select * from q;\ncreate trigger tr after insert on t begin update x set a=1; end;\nalter table users add y int;\ninsert into only§ values (1);\nupdate u§ set a = 1;\ncreate or replace view v§ as select 1;\n"),
    "scss": ("scss", "$x: 1px;\n// c\n.a§ { b: c; &:hover { d: url(a;b) } }\n@media (x) {\n .b{}\n}\n"),
    "css": ("css", "/* c */\n.a§ { b: c }\n@media print {\n .b { c: d }\n}\n"),
    "html": ("html", "<html><body>\n<header id=top>x</header>\n<div><section>\n<h2>Hi §</h2>\n</section></div><script>\nvar a;\n</script>\n</body></html>"),
    "py": ("python", "import os\n@dec\ndef f§():\n  pass\nX = 1\nclass A§:\n  'd'\n  y = 1\n\n  @property\n  def p(self): return 1\n\n  @p.setter\n  def p(self, v): pass\n"),
    "broken.py": ("python", "def f§():\n  pass\n\ndef g(:\n  x\n\ndef h§():\n  return 1\n"),
    "tsx": ("typescript", 'import React, { useState as us } from "react";\nimport "./side.css";\nexport const CONFIG = { a: 1 };\nexport function over§(a: string): string;\nexport function over§(a: any) {\n  return /[{}]/.test(a) ? `x${a}}` : "}";\n}\nexport default function App({ x }: Props) {\n  return <div className="a">it\'s {x}</div>;\n}\nclass Big§ {\n  x = 1;\n\n  static make() {\n    return new Big();\n  }\n  constructor() {}\n  get value() {\n    return this.x;\n  }\n}\ndescribe("things §", () => {\n  it("works", () => {});\n});\n'),
    "go": ("go", "package x§\n"),
}


def format_chunks(spark, sf_dir):
    """A file of each format for each supplier, split into chunks."""
    k = F.col("s_suppkey").cast("string")
    each = F.explode(F.array(*(F.struct(F.lit(ext).alias("ext"), F.lit(language).alias("language"), F.lit(source).alias("source")) for ext, (language, source) in TEMPLATES.items())))
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), each.alias("t"))
    files = rows.select(F.concat(F.lit("s/"), "k", F.lit("."), "t.ext").alias("path"), F.replace("t.source", F.lit("§"), F.col("k")).alias("source"), "t.language")
    return split_files(files).select("id", "file", "language", "kind", "name", "start_line", "end_line")


def import_graph(spark, sf_dir):
    edges = G.build_edges(split_files(customer_sources(spark, sf_dir)))
    return edges.select("kind", "from_file", "to_file", "name", "confidence", "evidence")


def graph_neighbors(spark, sf_dir):
    chunks = cut(split_files(customer_sources(spark, sf_dir)))
    names = chunks.select("id", "name")
    near = G.neighbors(G.build_edges(chunks), chunks)
    return near.join(names, "id").join(names.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other").select("name", "other_name", "confidence", "place")


def judgment_problems(spark, sf_dir):
    """Documents are candidates; labels are judgments, some of them twice and some for ids that no document has."""
    docs = table(spark, sf_dir, "documents").select(F.lit("t").alias("task_id"), F.col("doc_id").cast("string").alias("chunk_id"))
    labels = table(spark, sf_dir, "labels").select(F.lit("t").alias("task_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("quality").cast("double").alias("relevance"))
    twice = labels.where("cast(chunk_id as long) % 9 = 0")
    strange = labels.where("cast(chunk_id as long) % 7 = 0").withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id"))
    from seamline.operators.judge import check_judgments

    return check_judgments(docs, labels.unionByName(twice).unionByName(strange)).select("chunk_id", "problem")


def blended_scores(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.col("source").alias("task_id"), "doc_id", F.col("quality").cast("double").alias("relevance"), F.pmod("n_chars", F.lit(97)).cast("double").alias("total"))
    return R.blend_scores(rows, 0.1).select("doc_id", F.round("blended", 6).alias("blended"))


def json_result(spark, sf_dir):
    """Regions of the five best documents of each task as JSON."""
    best = bm25_top10(spark, sf_dir).where("rank <= 5")
    regions = L.merge_regions(best, doc_chunks(spark, sf_dir))
    shape = F.struct(F.col("file"), "language", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "content", F.col("chunk_ids").alias("chunks"))
    return regions.groupBy("task_id").agg(F.to_json(F.struct(F.lit(5).alias("schemaVersion"), F.lit("offline").alias("mode"), F.array_sort(F.collect_list(shape)).alias("regions"))).alias("payload"))


def entry(spark: SparkSession) -> DataFrame:
    """Regions that the engine returns for benchmark texts over the smallest documents."""
    sf_dir = "/root/testdata/sf0.001"
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("task"))
    result = engine.run(tasks, doc_chunks(spark, sf_dir))
    return result.regions.select("task_id", "file", "start_line", "end_line", "content", "chunk_ids", "relevance_key")


NAMES = [
    tokenize_documents, stem_vocabulary, term_frequency, doc_length_stats, bm25_scores, bm25_top10, lexical_normalized, partial_name_score, exact_key_join, symbol_signal,
    path_signal, suffix_match, proximity_signal, weighted_total_topk, best_edge_per_pair, one_hop_neighbors, expansion_capped, dedupe_first_by_rank, chunk_id_hash, distinct_lines,
    region_merge, event_regions, coverage, cover_match, recall_precision, macro_micro, evaluation_gates, evaluation_impact, evaluation_findings, candidate_recall, file_weights, paired_difference, character_shares, spread_min_mean_max, supports_closure,
    threshold_sweep, redact_tokens, classify_path, source_chunks, format_chunks, import_graph, graph_neighbors, judgment_problems, blended_scores, text_windows, html_regions, retrieve, json_result,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    from seamline.oracles import SQL

    return dict(SQL)
