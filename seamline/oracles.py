"""DuckDB SQL with the results of the queries in the registry."""

from __future__ import annotations

from seamline.config import RetrievalConfig
from seamline.functions.text import BOUNDARIES
from seamline.operators.evaluate import GATES, THRESHOLDS
from seamline.sources.files import FILE_TYPES, SHAPES


def split(x: str) -> str:
    for b in BOUNDARIES:
        x = rf"regexp_replace({x}, '{b}', '\1 \2', 'g')"
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) < 4 THEN {w} WHEN {w} LIKE '%ies' THEN {w}[:-4] || 'y' WHEN regexp_matches({w}, '(?:[sxz]|ch|sh)es$') THEN {w}[:-3] "
        f"WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(?:ss|us|is)$') THEN {w}[:-2] WHEN {w} LIKE '%ing' AND length({w}) >= 6 THEN {w}[:-4] "
        f"WHEN {w} LIKE '%ed' AND length({w}) >= 5 THEN {w}[:-3] ELSE {w} END"
    )


def stems(x: str) -> str:
    return f"list_transform({split(x)}, lambda s: {stem('s')})"


def tokens(x: str) -> str:
    return rf"list_filter({stems(x)}, lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '\p{{N}}+'))"


TEXT = "coalesce(text, '')"
FILE = "source || '/' || lang || '/' || doc_id || '.txt'"
BM25 = f"""
toks AS (SELECT doc_id::VARCHAR AS chunk_id, {FILE} AS file, {tokens(TEXT)} AS t FROM documents),
lens AS (SELECT chunk_id, file, len(t) AS dl FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT DISTINCT item_id::VARCHAR AS task_id, unnest({tokens(TEXT)}) AS term FROM benchmark),
scores AS (SELECT task_id, chunk_id, any_value(file) AS file, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 10) AS score
  FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id), stats GROUP BY ALL)"""
PARTS = f"""
tasks AS (SELECT p_brand AS task_id, list_distinct(flatten(list({tokens("p_type || ' ' || p_name")}))) AS words FROM part GROUP BY p_brand),
large AS (SELECT DISTINCT p_brand AS task_id, p_name AS exact FROM part WHERE p_size >= 45),
names AS (SELECT p_name AS name, min(p_partkey)::VARCHAR AS id FROM part GROUP BY p_name),
own AS (SELECT id, list_distinct({stems("split_part(name, '.', -1)")}) AS own FROM names)"""
KEYS = "list_distinct(list_filter([lower({0}), regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), array_to_string({1}, '')], lambda k: k <> ''))"


def keys(x: str) -> str:
    return KEYS.format(x, stems(x))


PARTIAL = """partial AS (SELECT task_id, id AS chunk_id, len(list_intersect(own, words)) AS c, len(own) AS n FROM tasks, own)"""
PAGES = f"""
files AS (SELECT DISTINCT regexp_extract(url, '^\\w+://([^?#]*)', 1) AS file FROM pages),
parts AS (SELECT file, string_split(file, '/') AS p FROM files),
tasks AS (SELECT DISTINCT p[1] AS task_id FROM parts),
said AS (SELECT DISTINCT p[1] AS task_id, unnest([p[-1], coalesce(p[2], '') || '/' || p[-1]]) AS term FROM parts),
suffixes AS (SELECT DISTINCT file, array_to_string(p[i:], '/') AS suffix FROM parts, unnest(range(1, len(p) + 1)) AS r(i))"""
TURNS = "turns AS (SELECT conv_id, turn, role, turn * 10 AS s, turn * 10 + floor(length(text) / 40)::BIGINT AS e FROM conversations)"


def merged(source: str, key: str) -> str:
    return f"""
marks AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -999999999) + 1 THEN 1 ELSE 0 END AS fresh FROM {source}),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marks)"""


EDGES = """
edges AS (SELECT 'c' || o_custkey AS from_id, 's' || l_suppkey AS to_id, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'heuristic' ELSE 'unresolved' END AS confidence,
  l_orderkey AS ord, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RANK = "CASE confidence WHEN 'exact' THEN 0 WHEN 'heuristic' THEN 1 ELSE 2 END"
W = RetrievalConfig().weights
REDACTED = TEXT
for _shape in SHAPES:
    REDACTED = f"regexp_replace({REDACTED}, '{_shape}', '[REDACTED]', 'g')"
_ASSIGNED = r"""(?i)((?:api[_-]?key|secret|token|passw(?:or)?d|credential)s?["'']?\s*(?::\s*[\w<>\[\]| ]+?\s*)?[:=]\s*["''`])[^"''`\n]{8,}(["''`])"""
REDACTED = rf"regexp_replace({REDACTED}, '{_ASSIGNED}', '\1[REDACTED]\2', 'g')"
KNOWN = ", ".join(f"('{e}', '{lang}', '{strategy}')" for lang, strategy, exts, _, _ in FILE_TYPES for e in exts.split())
LABELLED = "lab AS (SELECT l.*, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id))"

MODE_ROWS = f"""{LABELLED}, rows AS (SELECT source AS task_id, CASE WHEN length(source) % 2 = 0 THEN 'heldout' ELSE 'tuning' END AS split, CASE lang WHEN 'en' THEN 'judged' ELSE 'deterministic' END AS mode,
  sum(quality) AS hit, count(*) AS total, avg(quality) AS recall, avg(1 - toxic) AS precision, sum(n_chars) AS chars, 1 - sum(toxic * n_chars) / sum(n_chars) AS reduction, list_sort(list(DISTINCT n_chars % 2)) AS chosen FROM lab WHERE lang IN ('en', 'fr') GROUP BY ALL),
pairs AS (SELECT a.task_id, a.split, a.recall - b.recall AS recall, a.precision - b.precision AS precision, a.chars - b.chars AS chars, a.recall AS ra, b.recall AS rb, a.precision AS pa, b.precision AS pb, a.chosen AS ca, b.chosen AS cb
  FROM rows a JOIN rows b ON a.task_id = b.task_id AND a.mode = 'judged' AND b.mode = 'deterministic')"""
FLOORS = ", ".join(f"('{m}', '{k}', '{s}', {f})" for (m, k), fs in GATES.items() for s, f in zip(("tuning", "heldout"), fs, strict=True))

#: (extension, language, chunks as (first line, last line, kind, name)) of the generated sources; § is a number.
FORMATS = [
    ("md", "markdown", [(1, 2, "section", "preamble"), (3, 8, "section", "A§"), (5, 8, "section", "A§ > B"), (9, 11, "section", "Set")]),
    ("json", "json", [(2, 2, "config", "a§"), (3, 4, "config", "b"), (5, 5, "file", None)]),
    ("yaml", "yaml", [(1, 1, "config", "doc[0].a"), (2, 3, "config", "doc[0].b"), (4, 5, "config", "doc[0].c"), (8, 8, "config", "doc[1].d§")]),
    ("toml", "toml", [(1, 2, "config", "t"), (3, 4, "config", "a.b§"), (7, 8, "config", "p[0]"), (9, 10, "config", "p[1]")]),
    ("sql", "sql", [(1, 2, "table", "a.b§"), (4, 4, "query", "select from t§"), (5, 5, "query", "with q"), (6, 6, "function", "tr"), (7, 7, "config", "alter table users"), (8, 8, "query", "insert into only§"), (9, 9, "query", "update u§"), (10, 10, "table", "v§")]),
    ("scss", "scss", [(1, 1, "config", "$x"), (3, 3, "style", ".a§"), (4, 6, "style", "@media (x)")]),
    ("css", "css", [(2, 2, "style", ".a§"), (3, 5, "style", "@media print")]),
    ("html", "html", [(2, 2, "section", "header#top"), (3, 5, "section", 'section "Hi §"'), (5, 7, "section", "script")]),
    ("py", "python", [(2, 4, "function", "f§"), (5, 5, "config", "X"), (6, 8, "class", "A§"), (10, 11, "method", "A§.p"), (13, 14, "method", "A§.set p")]),
    ("broken.py", "python", [(1, 2, "function", "f§"), (4, 5, "section", None), (7, 8, "function", "h§")]),
    ("tsx", "typescript", [(3, 3, "config", "CONFIG"), (4, 7, "function", "over§"), (8, 10, "component", "App"), (11, 12, "class", "Big§"), (14, 16, "method", "Big§.make"), (18, 20, "method", "Big§.get value"), (22, 24, "section", "describe: things §")]),
    ("go", "go", [(1, 1, "file", None)]),
]
FORMAT_ROWS = ", ".join(f"('{ext}', '{language}', {s}, {e}, '{kind}', {'NULL' if name is None else repr(name)})" for ext, language, chunks in FORMATS for s, e, kind, name in chunks)

SOURCES = """
own AS (SELECT c_custkey AS k, 'src/' || lower(c_mktsegment) || '/c' AS d FROM customer),
src AS (SELECT k, d || k || '.ts' AS file, d || (k + 1) || '.ts' AS wanted FROM own),
imp AS (SELECT a.k, a.file AS from_file, b.file AS to_file, a.wanted FROM src a LEFT JOIN src b ON a.wanted = b.file)"""

SQL = {
    "tokenize_documents": f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens(TEXT)} AS t FROM documents)",
    "stem_vocabulary": f"SELECT word, {stem('word')} AS stem FROM (SELECT DISTINCT unnest({split('text')}) AS word FROM documents)",
    "term_frequency": f"WITH {BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term",
    "doc_length_stats": f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_scores": f"WITH {BM25} SELECT task_id, chunk_id, round(score, 6) AS score FROM scores",
    "bm25_top10": f"WITH {BM25} SELECT task_id, chunk_id, round(score, 6) AS total, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, file, chunk_id)::INT AS rank FROM scores QUALIFY rank <= 10",
    "lexical_normalized": f"WITH {BM25} SELECT task_id, chunk_id, round(score / max(score) OVER (PARTITION BY task_id), 6) AS lexical FROM scores",
    "partial_name_score": f"WITH {PARTS}, {PARTIAL} SELECT task_id, chunk_id, round(0.9 * c * c / (n * (c + 1)), 6) AS score FROM partial WHERE c > 0",
    "exact_key_join": f"WITH {PARTS} SELECT DISTINCT task_id, id AS chunk_id FROM large, names WHERE list_has_any({keys('exact')}, {keys('name')})",
    "symbol_signal": f"""WITH {PARTS}, {PARTIAL}, probe AS (SELECT DISTINCT task_id, {stem('x')} AS word FROM (SELECT task_id, unnest(flatten(list_transform(words, lambda v: {split('v')}))) AS x FROM tasks)),
  near AS (SELECT DISTINCT task_id, id AS chunk_id FROM probe JOIN (SELECT id, unnest(own) AS word FROM own) USING (word)),
  exact AS (SELECT DISTINCT task_id, id AS chunk_id FROM large, names WHERE list_has_any({keys('exact')}, {keys('name')})),
  joined AS (SELECT task_id, chunk_id, 1.0::DOUBLE AS symbol FROM exact UNION ALL SELECT task_id, chunk_id, 0.9 * c * c / (n * (c + 1)) FROM partial JOIN near USING (task_id, chunk_id) WHERE c > 0)
  SELECT task_id, chunk_id, round(max(symbol), 6) AS symbol FROM joined GROUP BY ALL""",
    "suffix_match": f"WITH {PAGES} SELECT task_id, term AS suffix, file FROM said JOIN suffixes ON term = suffix",
    "path_signal": rf"""WITH {PAGES},
  words AS (SELECT task_id, unnest(w) AS word, len(w) AS size FROM (SELECT task_id, list_distinct({tokens('task_id')}) AS w FROM tasks)),
  probe AS (SELECT DISTINCT task_id, word, size, {stem('x')} AS p FROM (SELECT *, unnest({split('word')}) AS x FROM words)),
  ext AS (SELECT file, p[-1] AS base, regexp_extract(p[-1], '^.+?(\.[^.]*)$', 1) AS ext FROM parts),
  own AS (SELECT DISTINCT file, unnest({stems('left(file, length(file) - length(ext))')}) AS p FROM ext),
  hits AS (SELECT task_id, file, count(DISTINCT word) / any_value(size) AS share FROM probe JOIN own USING (p) GROUP BY ALL),
  whole AS (SELECT task_id, file, 1.0 AS share FROM said JOIN suffixes ON term = suffix WHERE term LIKE '%/%' OR term LIKE '%.%'),
  share AS (SELECT task_id, file, max(share) AS share FROM (SELECT * FROM hits UNION ALL SELECT * FROM whole) GROUP BY ALL),
  named AS (SELECT DISTINCT task_id, file FROM said JOIN (SELECT file, unnest([lower(base), lower(left(base, length(base) - length(ext)))]) AS k FROM ext) ON lower(term) = k)
  SELECT task_id, file, round(least(1.0, coalesce(share, 0) + CASE WHEN named.file IS NULL THEN 0 ELSE 0.5 END), 6) AS path FROM share FULL JOIN named USING (task_id, file)""",
    "proximity_signal": "WITH d AS (SELECT doc_id, lang, source FROM documents), b AS (SELECT lang, arg_min(source, doc_id) AS best FROM d GROUP BY lang) SELECT doc_id, CASE WHEN source = best THEN 1.0 ELSE 0.0 END::DOUBLE AS proximity FROM d JOIN b USING (lang)",
    "weighted_total_topk": f"""WITH d AS (SELECT lang, doc_id, {FILE} AS file, (doc_id % 10)::DOUBLE AS a, (n_chars % 100)::DOUBLE AS b FROM documents),
  t AS (SELECT lang AS task_id, doc_id::VARCHAR AS chunk_id, file, round({W['symbol']} * a / 10 + {W['lexical']} * b / 100 + {W['path']} * a / 20 + {W['test']} + {W['proximity']} * b / 200, 9) AS total FROM d)
  SELECT task_id, chunk_id, round(total, 6) AS total, row_number() OVER (PARTITION BY task_id ORDER BY total DESC, file)::INT AS rank FROM t QUALIFY rank <= 40""",
    "best_edge_per_pair": f"WITH {EDGES} SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY from_id, to_id ORDER BY {RANK}, ord, line) = 1",
    "one_hop_neighbors": f"WITH {EDGES}, b AS (SELECT from_id AS id, to_id AS other, confidence FROM edges UNION ALL SELECT to_id, from_id, confidence FROM edges) SELECT id, other, arg_min(confidence, {RANK}) AS confidence FROM b WHERE confidence <> 'unresolved' GROUP BY ALL",
    "dedupe_first_by_rank": "SELECT source || '/' || lang AS file, n_chars % 50 AS start_line, lpad(doc_id::VARCHAR, 9, '0') AS chunk_id, round((doc_id % 7) / 7, 6) AS total FROM documents QUALIFY row_number() OVER (PARTITION BY file, start_line ORDER BY (doc_id % 7) DESC, doc_id) = 1",
    "chunk_id_hash": f"SELECT doc_id, left(sha256({FILE} || ':1-' || n_chars || ':file:' || source), 12) AS chunk_id FROM documents",
    "distinct_lines": "SELECT md5(line) AS line_hash, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1",
    "region_merge": f"WITH {TURNS}, {merged('turns', 'conv_id')} SELECT conv_id, min(s) AS start_line, max(e) AS end_line, count(*) AS members FROM runs GROUP BY conv_id, island",
    "event_regions": f"WITH ev AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s, epoch(date_trunc('second', ts))::BIGINT + floor(value)::BIGINT AS e FROM events), {merged('ev', 'user_id')} SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS members FROM runs GROUP BY user_id, island",
    "coverage": f"""WITH {TURNS}, own AS (SELECT conv_id, turn AS unit, unnest(range(s, e + 1)) AS line FROM turns WHERE role = 'assistant'),
  sel AS (SELECT DISTINCT conv_id, unnest(range(s, e + 1)) AS line FROM turns WHERE role <> 'assistant')
  SELECT conv_id, unit, count(sel.line) >= 0.8 * count(*) AS covered FROM own LEFT JOIN sel USING (conv_id, line) GROUP BY ALL""",
    "cover_match": f"""WITH {TURNS}, p AS (SELECT a.conv_id, a.turn, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS common, a.e - a.s + 1 AS la, b.e - b.s + 1 AS lb FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.role <> 'assistant' AND b.role = 'assistant')
  SELECT DISTINCT conv_id, turn FROM p WHERE common > 0 AND (common >= 0.8 * la OR common >= 0.8 * lb)""",
    "recall_precision": f"WITH {LABELLED} SELECT lang, source, round(avg(quality), 6) AS recall, round(avg(1 - toxic), 6) AS precision FROM lab GROUP BY ALL",
    "macro_micro": f"""WITH {LABELLED}, t AS (SELECT lang AS mode, CASE WHEN doc_id % 3 = 0 THEN 'heldout' ELSE 'tuning' END AS split, source, sum(quality) AS hit, count(*) AS total, sum(quality) / count(*) AS recall, avg(1 - toxic) AS precision, 1 - sum(quality * n_chars) / sum(n_chars) AS size_reduction FROM lab GROUP BY ALL),
  a AS (SELECT mode, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, grouping(split) AS g, count(DISTINCT split) AS n, count(*) AS tasks, round(avg(recall), 6) AS recall_macro, round(sum(hit) / sum(total), 6) AS recall_micro, round(avg(precision), 6) AS precision_macro, round(avg(size_reduction), 6) AS size_reduction_macro FROM t GROUP BY GROUPING SETS ((mode, t.split), (mode)))
  SELECT mode, split, tasks, recall_macro, recall_micro, precision_macro, size_reduction_macro FROM a WHERE g = 0 OR n > 1""",
    "evaluation_gates": f"""WITH {MODE_ROWS}, agg AS (SELECT mode, split, sum(hit) / sum(total) AS recall, avg(precision) AS precision, avg(reduction) AS size_reduction FROM rows GROUP BY ALL),
  vals AS (UNPIVOT agg ON recall, precision, size_reduction INTO NAME metric VALUE value), floors(mode, metric, split, floor) AS (VALUES {FLOORS})
  SELECT mode, metric, split, round(value, 6) AS value, round(floor::DOUBLE, 6) AS floor, coalesce(value >= floor, false) AS passed FROM floors LEFT JOIN vals USING (mode, metric, split)
  UNION ALL SELECT 'judged', 'precision over deterministic', s.split, round(a.precision, 6), round(b.precision, 6), coalesce(a.precision > b.precision, false) FROM (VALUES ('tuning'), ('heldout')) s(split)
    LEFT JOIN agg a ON a.split = s.split AND a.mode = 'judged' LEFT JOIN agg b ON b.split = s.split AND b.mode = 'deterministic'""",
    "evaluation_impact": f"""WITH {MODE_ROWS}, g AS (SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, grouping(split) AS whole, count(DISTINCT split) AS splits, count(*) AS tasks, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
    round(avg(chars), 6) AS selected_chars, count(*) FILTER (recall > 0) AS better, count(*) FILTER (recall = 0) AS same, count(*) FILTER (recall < 0) AS worse FROM pairs GROUP BY GROUPING SETS ((pairs.split), ()))
  SELECT split, tasks, recall, precision, selected_chars, better, same, worse FROM g WHERE whole = 0 OR splits > 1""",
    "evaluation_findings": f"""WITH {MODE_ROWS} SELECT task_id, CASE WHEN ra < rb THEN 'regression' WHEN ca = cb THEN 'identical' WHEN ra <= rb AND pa <= pb THEN 'no-gain' END AS finding FROM pairs WHERE finding IS NOT NULL""",
    "candidate_recall": f"""WITH {LABELLED}, u AS (SELECT lang AS task_id, source, max(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS hit FROM lab WHERE quality = 1 GROUP BY ALL) SELECT task_id, sum(hit)::BIGINT AS found, count(*) AS total FROM u GROUP BY task_id""",
    "file_weights": rf"""WITH l AS (SELECT {FILE} AS file, unnest(p) AS x, len(p) AS n, generate_subscripts(p, 1) AS i FROM (SELECT *, string_split({TEXT}, chr(10)) AS p FROM documents)),
  c AS (SELECT file, length(x) + length(regexp_replace(x, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) + CASE WHEN i < n THEN 1 ELSE 0 END AS chars FROM l)
  SELECT file, count(*) AS lines, sum(chars)::BIGINT AS chars, max(chars) AS longest FROM c GROUP BY file""",
    "paired_difference": f"""WITH {LABELLED}, t AS (SELECT source AS task_id, lang, avg(quality) AS r, avg(toxic) AS p FROM lab GROUP BY ALL)
  SELECT task_id, round(a.r - b.r, 6) AS recall, round(a.p - b.p, 6) AS precision FROM t a JOIN t b USING (task_id) WHERE a.lang = 'en' AND b.lang = 'fr'""",
    "character_shares": f"""WITH {LABELLED} SELECT lang, sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END)::BIGINT AS wanted, sum(CASE WHEN quality <> 1 AND toxic = 1 THEN n_chars ELSE 0 END)::BIGINT AS irrelevant, sum(CASE WHEN quality <> 1 AND toxic <> 1 THEN n_chars ELSE 0 END)::BIGINT AS unlabeled FROM lab GROUP BY lang""",
    "spread_min_mean_max": "SELECT event_type, count(value) AS n, min(value) AS min, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY event_type",
    "supports_closure": "WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id || ':' || last AS id, conv_id || ':' || c.turn AS support_id FROM conversations c JOIN l USING (conv_id) WHERE c.turn < last",
    "threshold_sweep": f"""WITH {LABELLED}, r AS (SELECT lang AS split, (n_chars % 97) / 97 AS score, quality = 1 AS req, t.threshold FROM lab, (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold) t),
  c AS (SELECT split, threshold, count(*) FILTER (score >= threshold) AS selected, count(*) FILTER (score >= threshold AND req) AS hit, count(*) FILTER (req) AS required FROM r GROUP BY ALL)
  SELECT split, threshold, selected, required, round(CASE WHEN required = 0 THEN 1.0 ELSE hit / required END, 6) AS recall, round(CASE WHEN selected = 0 THEN NULL ELSE hit / selected END, 6) AS precision FROM c""",
    "redact_tokens": f"SELECT doc_id, md5({REDACTED}) AS digest FROM documents",
    "classify_path": f"""WITH known(ext, language, strategy) AS (VALUES {KNOWN}),
  d AS (SELECT doc_id, source || '/f' || ['.ts', '.js', '.py', '.sql', '.md', '.toml', '.rs', '.weird', '', '.Dockerfile'][doc_id % 10 + 1] AS path, doc_id % 4 = 0 AS bang, left(text, 1024) AS head FROM documents),
  e AS (SELECT *, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext FROM d)
  SELECT doc_id, path, CASE WHEN k.language IS NOT NULL THEN k.language WHEN bang THEN 'python' ELSE 'text' END AS language,
    CASE WHEN k.strategy IS NOT NULL THEN k.strategy WHEN bang THEN 'semantic' ELSE 'text' END AS strategy,
    CASE WHEN k.language IS NOT NULL THEN 'extension ' || e.ext WHEN bang THEN 'shebang python' WHEN e.ext = '' THEN 'no extension, content looks like text' ELSE 'unknown extension ' || e.ext || ', content looks like text' END AS reason
  FROM e LEFT JOIN known k USING (ext)""",
    "source_chunks": f"""WITH {SOURCES}, c AS (
  SELECT file, 'function' AS kind, 'f' || k AS name, 2 AS s, 4 AS e, 'export function f' || k || '() {{' || chr(10) || '  return f' || (k + 1) || '();' || chr(10) || '}}' AS content FROM src
  UNION ALL SELECT d || k || '.test.ts', 'function', 'test: c' || k, 1, 3, 'test("c' || k || '", () => {{' || chr(10) || '  run();' || chr(10) || '}});' FROM own WHERE k % 10 = 0)
  SELECT left(sha256(file || ':' || s || '-' || e || ':' || kind || ':' || name), 12) AS id, file, kind, name, s AS start_line, e AS end_line, content FROM c""",
    "format_chunks": f"""WITH shapes(ext, language, s, e, kind, label) AS (VALUES {FORMAT_ROWS}),
  c AS (SELECT 's/' || s_suppkey || '.' || ext AS file, language, kind, replace(label, '§', s_suppkey::VARCHAR) AS name, s, e FROM supplier, shapes)
  SELECT left(sha256(file || ':' || s || '-' || e || ':' || kind || ':' || coalesce(name, '')), 12) AS id, file, language, kind, name, s AS start_line, e AS end_line FROM c""",
    "import_graph": f"""WITH {SOURCES}
  SELECT 'import' AS kind, from_file, to_file, 'f' || (k + 1) AS name, CASE WHEN to_file IS NULL THEN 'unresolved' ELSE 'exact' END AS confidence,
    CASE WHEN to_file IS NULL THEN 'no such file in the scanned repository: ' || replace(wanted, '.ts', '.js') ELSE 'import "./c' || (k + 1) || '.js" resolved to ' || to_file || ' (.js specifier mapped to .ts source); f' || (k + 1) || ' is a chunk there' END AS evidence FROM imp
  UNION ALL SELECT 'test', d || k || '.test.ts', d || k || '.ts', d || k || '.ts', 'heuristic', 'test file naming convention: ' || d || k || '.test.ts <-> ' || d || k || '.ts' FROM own WHERE k % 10 = 0""",
    "graph_neighbors": f"""WITH {SOURCES}, e AS (SELECT k AS a, k + 1 AS b, from_file AS fa, to_file AS fb FROM imp WHERE to_file IS NOT NULL), n AS (SELECT a, b, fb AS f FROM e UNION ALL SELECT b, a, fa FROM e)
  SELECT 'f' || a AS name, 'f' || b AS other_name, 'exact' AS confidence, row_number() OVER (PARTITION BY a ORDER BY f)::INT AS place FROM n""",
    "judgment_problems": """WITH c AS (SELECT doc_id::VARCHAR AS id FROM documents),
  j AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END AS n FROM labels UNION ALL SELECT 'x' || doc_id, 1 FROM labels WHERE doc_id % 7 = 0)
  SELECT coalesce(c.id, j.id) AS chunk_id, CASE WHEN c.id IS NULL THEN 'unknown' WHEN j.id IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM c FULL JOIN j ON c.id = j.id WHERE c.id IS NULL OR j.id IS NULL OR n > 1""",
    "blended_scores": f"WITH {LABELLED} SELECT doc_id, round(quality + 0.1 * coalesce((n_chars % 97) / nullif(max(n_chars % 97) OVER (PARTITION BY source), 0), 0), 6) AS blended FROM lab",
}
