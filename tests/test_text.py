import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamline.functions import terms
from seamline.functions import text as T
from seamline.operators import index as ix
from seamline.operators import score as S

STEMS = [("retries", "retry"), ("retry", "retry"), ("classes", "class"), ("boxes", "box"), ("matches", "match"), ("flashes", "flash"), ("status", "status"), ("statuses", "status"), ("analysis", "analysis"), ("names", "name"), ("sending", "send"), ("added", "add"), ("ring", "ring"), ("red", "red"), ("glass", "glass")]


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column).collect()]


def test_identifiers_split(spark):
    cases = {"listByStatus": "list by status", "HTTPServer": "http server", "sha256Hash": "sha 256 hash", "a_b-c.d/e": "a b c d e", "ÉtatÜber": "état über", "": "", "__": ""}
    got = values(spark, T.split_identifier("t"), list(cases))
    assert [" ".join(g) for g in got] == list(cases.values())
    assert [" ".join(terms.split_words(t)) for t in cases] == list(cases.values())


def test_stems(spark):
    assert values(spark, T.stem("t"), [w for w, _ in STEMS]) == [s for _, s in STEMS]
    assert [terms.stem_word(w) for w, _ in STEMS] == [s for _, s in STEMS]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abcEDing sxz_.19é", max_size=20), min_size=1, max_size=20))
def test_column_and_plain_splitting_agree(spark, texts):
    got = values(spark, T.stemmed_words("t"), texts)
    assert got == [[terms.stem_word(w) for w in terms.split_words(t)] for t in texts]


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", "send mail now ok yes"), ("b", "other words here"), ("c", "more of them too")], "id string, content string")
    got = ix.bm25(chunks, spark.createDataFrame([("t", "mail")], "task_id string, term string")).collect()
    want = math.log(1 + (3 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * 5 / 4))
    assert [(r.chunk_id, r.score) for r in got] == [("a", pytest.approx(want, abs=1e-9))]


def test_partial_names(spark):
    words = F.array(F.lit("send"), F.lit("reminder"))
    got = values(spark, S.partial_name_score(F.col("t"), words), ["sendReminder", "reminder", "Mail.sendInvoice", "total"])
    assert got == [pytest.approx(0.6), pytest.approx(0.45), pytest.approx(0.225), 0.0]


def path_of(spark, words, exact, files):
    t = spark.createDataFrame([("t", words, exact, [])], "task_id string, words array<string>, exact array<string>, variants array<string>")
    return {r.file: r.path for r in S.path_signals(t, spark.createDataFrame([(f,) for f in files], "file string")).collect()}


def test_path_bonus(spark):
    four = ["fix", "invoice", "due", "date"]
    assert path_of(spark, four, ["invoice"], ["src/invoice.ts"]) == {"src/invoice.ts": 0.75}
    assert path_of(spark, ["invoice"], ["invoice"], ["src/invoice.ts"]) == {"src/invoice.ts": 1.0}
    assert path_of(spark, four, [], ["src/invoice.ts"]) == {"src/invoice.ts": 0.25}
    assert path_of(spark, four, ["config/app.toml"], ["x/config/app.toml", "config/app.json"]) == {"x/config/app.toml": 1.0}


def test_lookups_stem_twice(spark):
    """A stemmed task word is stemmed again where names are looked up, unless that is turned off."""
    t = spark.createDataFrame([("t", ["binding"], [], [])], "task_id string, words array<string>, exact array<string>, variants array<string>")
    chunks = spark.createDataFrame([("a", "bindings")], "id string, name string")
    assert S.symbol_signals(t, chunks).count() == 0
    assert S.symbol_signals(t, chunks, double_stem=False).count() == 1


def test_task_terms():
    t = terms.extract_terms("Fix the `parseArgs` flag so that the due date in app.toml isn't lost by Billing.Invoice()")
    assert t.exact == ["parseArgs", "app.toml", "Billing.Invoice", "Billing", "Invoice"]
    assert "duedate" in t.variants and "parseargs" in t.variants
    assert t.related == ["cli", "argv", "option"]
    assert not t.mentions_tests and terms.extract_terms("fix the specs").mentions_tests
    assert terms.extract_terms("") == ([], [], [], [])


def test_utf16_and_cutting(spark):
    assert values(spark, T.utf16_length("t"), ["a😀", ""]) == [3, 0]
    assert values(spark, T.judged_code("t", 3, "!"), ["abc", "abcd", "a😀b", "ab😀"]) == ["abc", "abc!", "a😀!", "ab!"]


def test_markup_helpers(spark):
    assert values(spark, T.code_span("t"), ["a`b", "x", "`"]) == ["`` a`b ``", "` x `", "`` ` ``"]
    assert values(spark, T.longest_backtick_run("t"), ["a``b`", "x"]) == [2, 0]
    assert values(spark, T.fence_for("t"), ["a```b", "x"]) == ["````", "```"]
    assert values(spark, T.sanitize_inline("t"), ["a b\nc"]) == ["a b�c"]
    assert values(spark, T.collapse("t"), ["  a \n b "]) == ["a b"]


def test_paths(spark):
    assert values(spark, T.normalize_path(F.col("t")), ["a/./b/../c", "../x", "a/../../b"]) == ["a/c", "../x", "../b"]
    assert values(spark, T.is_test_file("t"), ["a/b.test.ts", "tests/x.py", "test_a.py", "a_test.py", "src/testing.ts"]) == [True, True, True, True, False]
    assert values(spark, T.directory_of("t"), ["a/b/c.ts", "c.ts"]) == ["a/b", ""]
    assert values(spark, T.extension_of("t"), ["a/b.test.ts", ".env", "x"]) == [".ts", "", ""]
