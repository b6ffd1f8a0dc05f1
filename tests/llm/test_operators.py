"""Each operator against SQL, brute force, a round trip or held-out labels, and on odd rows."""

import hashlib
import html
import math
import os
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard as zs
from pyspark.sql import functions as F

from seamline.llm import chat, decontaminate, exact_dedup, html_extract, langid, license_scan, mixing, quality, queries, simhash, toxicity
from tests.oracle import SF, assert_same, rows_of

ROOT = Path(__file__).resolve().parents[2]
Q, SQL = queries.queries(), queries.oracle_sql()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 3), (4, "one", "en", None, 3), (5, LONG, "en", "a", len(LONG)), (5, LONG, "en", "a", len(LONG)), (None, "one", "fr", "b", 3), (6, "ONE", "en", "b", 3), (7, "é 😀 日本 ß", "de", "b", 8), (8, "a b c d e f g", "en", "a", 13)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, DOCS).select("*", *(F.lit(i).alias(c) for i, c in enumerate(ODD_CLASH)))


ODD_CLASH = ["f", "h", "sha", "part", "fp", "norm", "row", "id", "label", "score", "copy", "host", "units", "key", "node", "size", "of", "cdf", "numbers", "n", "draws", "_draws", "_cdf", "_source", "_n", "drop_id", "sketch", "shuffle_key"]


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, Q[name], SQL[name])


# exact duplicates


def test_rice_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        x = np.unique(rng.integers(0, 1 << 40, n))
        k = exact_dedup.rice_parameter(len(x), 1 << 40)
        gaps = np.diff(x, prepend=0)
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(gaps, k), len(x), k) == gaps).all()


def test_exact_groups_on_odd_rows(odd, empty):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == len(ODD)
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[lower(t)].append(i)
    want = sorted(((str(i), str(max((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_keeps_one_of_each_text(odd, empty):
    out = exact_dedup.exact_dedup(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id, lower(r.text)) for r in out.collect()) == sorted({lower(t): (i, lower(t)) for i, t, *_ in sorted(ODD, key=lambda r: r[0] or 0)}.values())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_one_large_group_of_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text")).repartition(17)
    got = exact_dedup.exact_groups(df).where("group_size > 1").agg(F.count("*").alias("n"), F.max("keep_id").alias("k"), F.sum(F.col("kept").cast("int")).alias("s")).first()
    assert (got.n, got.k, got.s) == (1000, 2997, 1)


# mixing


def test_poisson_counts(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5700, "big").when(F.col("id") < 5990, "mid").otherwise("tiny").alias("source"))
    got = {r.source: r["count"] for r in mixing.poisson_mix(df, weights={"big": 1, "mid": 1, "tiny": 2}, epochs=1.0).groupBy("source").count().collect()}
    for s, want in {"big": 1500, "mid": 1500, "tiny": 3000}.items():  # 10 rows repeat 300 times each
        assert abs(got[s] - want) < 6 * math.sqrt(want)


def test_mixing_odd_rows(odd, empty):
    out = mixing.poisson_mix(odd, epochs=20.0)
    assert out.columns == [*(c for c in odd.columns if c not in ("copy", "shuffle_key")), "copy", "shuffle_key"]
    assert {r._n for r in out.collect()} == {ODD_CLASH.index("_n")}
    assert {r.source for r in out.collect()} == {None, "a", "b"}
    assert out.count() == mixing.poisson_mix(odd, epochs=20.0).count()
    assert mixing.poisson_mix(empty).count() == 0


# near duplicates


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    ids = sorted(prints, key=lambda i: (i is None, i))
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i))
                up[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(docs):
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    want = components(prints)
    got = simhash.near_groups(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_simhash_odd_rows(odd, empty):
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(ODD)
    want = components({i: fingerprint(t) for i, t, *_ in ODD})
    assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else 4) for r in got)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_groups(empty).count() == 0
    assert simhash.near_dedup(odd).columns == odd.columns


def test_links_through_full_buckets(spark, monkeypatch):
    """Buckets are split when they are full, and no link is lost."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 62, 6).tolist()
    prints = sorted({c ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False)) for c in centres for _ in range(60)})
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.label for r in simhash.components(simhash.links(fps, len(prints))).collect()}
    assert {p: got.get(p, p) for p in prints} == components({p: p for p in prints})


@pytest.mark.parametrize("most", [0, simhash.TASK_LINKS])
def test_components_by_task_and_by_rounds(spark, monkeypatch, most):
    """A chain, a star and a pair; few links take few jobs, however long the chains."""
    monkeypatch.setattr(simhash, "TASK_LINKS", most)
    pairs = [*((i, i + 1) for i in range(-20, 20)), *((100, i) for i in range(90, 110)), (500, 400)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup(f"links {most}", "")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"links {most}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: -20 for i in range(-20, 21)} | {i: 90 for i in range(90, 110)} | {400: 400, 500: 400}
    assert jobs <= 8 if most else jobs > 20
    assert simhash.components(edges.where("a > 1000")).count() == 0


def test_pairs_meet_once(spark):
    """Sets that share many keys come out as a pair under one of them, in whichever tasks the keys are."""
    keys, sets = list(range(-5, 35)), [simhash._sketch(np.arange(i, i + 64, dtype=np.uint64)) for i in range(6)]
    rows = [(k, 64, i, i, sets[i], keys[: simhash.CARRIED_KEYS]) for k in keys for i in range(6)]
    names = ["key", "size", "node", "label", "sketch", "keys"]
    got = []
    for k in keys:
        one = [r for r in rows if r[0] == k]
        types = [*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64())]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*one, strict=True), types, strict=True)], names)
        got += [tuple(r.values()) for b in simhash._candidates(False)([batch]) for r in b.to_pylist()]
    assert sorted(got) == [(i, j) for i in range(6) for j in range(i + 1, 6)]


def similar_heads(texts):
    """Smallest id of each id's component, where sets of five-word shingles with a Jaccard similarity of 0.8 link."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in texts.items()}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in ids}


def near_copies(n):
    """Texts around the threshold: each third one is new, the others change up to two words of the one before."""
    rng, out, w = np.random.default_rng(5), {}, []
    for k in range(n):
        w = [f"v{int(x)}" for x in rng.integers(0, 500, 5 + k)] if k % 3 == 0 else w[:]
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = f"e{k}"
        out[100_000 + k] = " ".join(w)
    return out


def test_near_dedup_equals_brute_force_jaccard(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()} | near_copies(150)
    got = simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(similar_heads(texts).values())


def test_near_dedup_of_frequent_keys(spark, monkeypatch):
    """Keys of more nodes than fit a bucket are split, frequent ones are dealt at once, and no link is lost."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    monkeypatch.setattr(simhash, "HOT", 8)
    base = [f"b{i}" for i in range(60)]
    texts = dict(enumerate(near_copies(40).values()))
    for k in range(120):  # one large group of near copies, and texts that share a passage with it
        w = base[:]
        w[k % 60] = f"n{k}"
        texts[1000 + k] = " ".join(w if k % 2 else [f"o{k}{i}" for i in range(90)] + base[:20])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == similar_heads(texts)


def test_near_dedup_decides_by_row(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = simhash.near_dedup(spark.createDataFrame([(1, a), (2, a + " more"), (2, b), (None, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, a), (1, a), (2, b)]


def test_allocation():
    flat = [[1.0, 9.0, 99.0]] * 3
    assert simhash.allocate(flat) == (3.0, [0, 0, 0])
    spent, chosen = simhash.allocate([[1e6, 1e6, 1e6], [1.0, 2.0, 1e6], [1.0, 5.0, 9.0]])
    assert chosen == [-1, 1, 0] and sum(t + 1 for t in chosen) == 3 and spent == 3.0


# toxicity


def planted(rng, n, bad):
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        w = [str(x) for x in rng.choice(vocabulary, rng.integers(30, 200))]
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            w.insert(int(rng.integers(len(w))), str(rng.choice(bad)))
        out.append((i, " ".join(w), toxic))
    return out


def test_toxicity_on_planted_words(spark):
    rows = planted(np.random.default_rng(2), 900, ["grumbling", "vexatious", "obnoxian", "quarrelix"])
    model = toxicity.fit([(t, y) for _, t, y in rows[:600]])
    test = spark.createDataFrame([(i, t) for i, t, _ in rows[600:]], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(test, model).collect()}
    right = [(got[i] >= 0.7) == bool(y) for i, _, y in rows[600:]]
    assert np.mean(right) >= 0.97
    kept = {r.doc_id for r in toxicity.keep_clean(test, model).collect()}
    assert kept == {i for i in got if got[i] < 0.7}


def test_toxicity_odd_rows(odd, empty):
    model = toxicity.fit([])
    assert all(r.score < 0.01 for r in toxicity.score(odd, model).collect())
    labelled = toxicity.fit([("bad grumble word", 1), ("plain word", 0), ("bad grumble", 1), ("plain text", 0)])
    rows = toxicity.score(odd, labelled).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, labelled).count() == 0
    assert toxicity.keep_clean(odd, labelled, reject=1.1).count() == len(ODD)


def test_toxicity_score_equals_its_definition(spark):
    """Score of each text by compressing every window anew, without the model's caches."""
    rows = planted(np.random.default_rng(7), 400, ["grumbling", "vexatious", "obnoxian", "quarrelix"])
    model = toxicity.fit([(t, y) for _, t, y in rows[:300]])
    ordinary, toxic, tail = model.parts
    p = zs.ZstdCompressionParameters.from_level(19, source_size=128, dict_size=1 << 16, hash_log=17, chain_log=17, search_log=6, min_match=3, strategy=zs.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)

    def length(content, data):
        return len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(b"\n" * 64 + content + tail, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p).compress(data))

    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in rows[300:320]], "doc_id long, text string"), model).collect()}
    for i, t, _ in rows[300:320]:
        over, seen = [], t.lower().split()
        for w in (w.encode() for w in seen):
            data = tail[-toxicity.PRIMER :] + b" " + w + b" " + tail[: toxicity.PRIMER]
            if (saved := length(ordinary, data) - length(toxic, data)) >= model.thresholds[len(w)]:
                over.append(saved - model.thresholds[len(w)])
        x = math.log1p(len(over)), math.log1p(100 * len(over) / len(seen)), math.log1p(sum(over))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.curve[0] + sum(w * v for w, v in zip(model.curve[1:], x, strict=True))))))


def test_training_rows_leave_the_held_fold_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.join(docs, "doc_id").where((F.crc32(F.col("doc_id").cast("string")) % 3) != 1).count()
    assert len(toxicity.training_rows(docs, labels, folds=3, held=1)) == known


# language


def direct_length(model_texts, text, size):
    """Code length by the recursive definition."""
    counts = defaultdict(Counter)
    fold = lambda t: bytes(langid.FOLD[b] for b in (" " * langid.ORDER + t).encode())
    stream = b"".join(map(fold, model_texts))
    for i in range(langid.ORDER, len(stream)):
        for k in range(langid.ORDER + 1):
            counts[stream[i - k : i]][stream[i]] += 1

    def length(context, symbol):
        c = counts.get(context)
        if not c:
            return length(context[1:], symbol) if context else math.log2(size)
        n, q = sum(c.values()), len(c)
        if symbol in c:
            return -math.log2(c[symbol] / (n + q))
        return -math.log2(q / (n + q)) + (length(context[1:], symbol) if context else math.log2(size))

    s = fold(text)
    return sum(length(s[i - langid.ORDER : i], s[i]) for i in range(langid.ORDER, len(s)))


@pytest.mark.parametrize("languages", [2, 60])
def test_code_lengths_equal_the_definition(languages):
    """At the shipped settings, however many languages there are."""
    rng = np.random.default_rng(9)
    samples = {"x": ["the cat sat on the mat", "the hat"], "y": ["le chat est la", "les chats"]}
    for k in range(languages - 2):  # alphabets of their own, in part beyond ASCII
        letters = [chr(97 + (k * 7 + j) % 26) for j in range(6)] + [chr(0xC0 + k * 5 + j) for j in range(5)] + [" "]
        samples[f"l{k}"] = ["".join(rng.choice(letters, 300)) for _ in range(3)]
    model = langid.Model(samples)
    texts = ["the chat", "", "zqz ~", "a", *(t[0][:60] for t in list(samples.values())[::9])]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = model.code_lengths(np.frombuffer(data, np.uint8), offsets)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.langs):
            assert got[i, j] == pytest.approx(direct_length(samples[lang], t, model.size), abs=1e-6)


def test_training_texts_are_read_in_two_passes_and_bounded(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("often").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = langid.training_texts(df, folds=4, held=2, most=300)
    assert set(got) == {"rare", "often"} and all(200 < len(t) < 400 for t in got.values())
    assert langid.training_texts(df.where("1 = 0")) == {}


def test_language_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q["op5_ppm_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97


def test_language_odd_rows(odd, empty):
    model = langid.Model(langid.training_texts(odd))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model).collect()]
    assert {i: lang for i, lang, _ in got if i in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(0 <= s <= 1 and lang in {"und", "en", "de", "fr"} for _, lang, s in got) and len(got) == len(ODD)
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.Model({})).collect()} == {"und"}


# decontamination


def best_similarity(text, item):
    """Best weighted Jaccard over all stretches of a text, by shingles of five words."""
    shingle = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    doc, bag = shingle(words(text)), Counter(shingle(words(item)))
    size, best = sum(bag.values()), 0.0
    for a in range(len(doc)):
        for b in range(a + max(1, int(0.75 * size)), min(len(doc), a + int(1.3 * size) + 1) + 1):
            both = sum((Counter(doc[a:b]) & bag).values())
            best = max(best, both / (b - a + size - both))
    return best


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijk"), 5))
    items = [(i, " ".join(word() for _ in range(int(n)))) for i, n in enumerate([15, 22, 30, 41, 59, 160])]
    docs = []
    for k in range(150):
        body = [word() for _ in range(int(rng.integers(0, 150)))]
        if k % 2:
            piece = items[k % 6][1].split()
            for _ in range(k % 4):  # edits of a word each
                piece[int(rng.integers(len(piece)))] = word()
            piece = piece[: len(piece) - k % 3]
            at = int(rng.integers(len(body) + 1))
            body[at:at] = [w.upper() for w in piece]
        docs.append((k, " \n".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x"), (99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_items(df, bench).collect()}
    want = {(d, i): s for d, t in docs for i, x in items if (s := best_similarity(t, x)) >= 0.8}
    assert got == pytest.approx(want)
    clean = {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}


def test_items_of_a_few_words_and_other_ids(spark):
    bench = spark.createDataFrame([("a", "one two"), ("b", "one"), ("c", "two one two three"), ("d", "")], "item_id string, text string")
    df = spark.createDataFrame([(1, "x ONE  two y one two"), (2, "one"), (3, "two"), (4, "two one\ttwo three four five six")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity, r.first_word) for r in decontaminate.find_items(df, bench).collect()}
    assert got == {(1, "a", 1.0, 1), (1, "b", 1.0, 1), (2, "b", 1.0, 0), (4, "a", 1.0, 1), (4, "b", 1.0, 1), (4, "c", 1.0, 0)}
    assert [r.doc_id for r in decontaminate.decontaminate(df, bench).collect()] == [3]


def test_shingles_find_what_fingerprints_lose():
    """Near the threshold some fingerprints differ by more than RADIUS; dense places find these as well."""
    lost, n = 0, 600
    items = [[f"i{k}_{j}" for j in range(54)] for k in range(n)]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    for k, w in enumerate(items):
        text = [f"x{k}_{j}" for j in range(43)] + w[:27] + ["other"] + w[28:] + [f"y{k}_{j}" for j in range(50)]
        hashes = np.array(decontaminate.shingles(" ".join(text).encode()), np.uint64)
        whole, places = np.array([len(hashes)]), np.flatnonzero(np.isin(hashes, index.keys))
        assert list(index.search(hashes, whole)) == [(0, k, 45 / 55, 43)]
        lost += k not in {i for *_, i in index._near_windows(hashes, whole, whole, places)}
    assert 0 < lost < n / 10


def test_a_text_that_repeats_an_item_often():
    item = " ".join(f"i{j}" for j in range(40))
    index = decontaminate.Index([(1, item)])
    hashes = np.array(decontaminate.shingles((item[:-4] + "x " + (item + " ") * 3000).encode()), np.uint64)
    assert [r[:3] for r in index.search(hashes, np.array([len(hashes)]))] == [(0, 0, 1.0)]


def test_decontamination_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_items(odd, bench).collect()] == [(8, 1)]
    out = decontaminate.decontaminate(odd, bench)
    assert out.columns == odd.columns and out.count() == len(ODD) - 1
    assert decontaminate.find_items(empty, bench).count() == 0
    assert decontaminate.find_items(odd, bench.where("1 = 0")).count() == 0


@pytest.mark.parametrize("size", [100, 200, 300])
def test_long_items_at_the_threshold(size):
    item = [f"i{j}" for j in range(size + 4)]
    index = decontaminate.Index([(1, " ".join(item)), (2, " ".join(f"k{j}" for j in range(size + 9)))])
    more = size // 4 - 9  # words put in: the stretch is longer by these, and holds all shingles but four
    for at in range(size // 3, 2 * size // 3, 7):
        text = [f"x{j}" for j in range(91)] + item[:at] + [f"y{j}" for j in range(more)] + item[at:] + [f"z{j}" for j in range(83)]
        hashes = np.array(decontaminate.shingles(" ".join(text).encode()), np.uint64)
        (got,) = index.search(hashes, np.array([len(hashes)]))
        assert got == (0, 0, (size - 4) / (size + more + 4), 91)


def test_near_finds_all_within_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    c = decontaminate.SizeClass(list(range(40)), [20] * 40, prints)
    probes = np.array([p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 16, replace=False))) for k, p in enumerate(np.repeat(prints, 8))], np.uint64)
    w, i = c.near(probes)
    want = {(a, b) for a, p in enumerate(probes) for b, q in enumerate(prints) if (int(p) ^ int(q)).bit_count() <= decontaminate.RADIUS}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want


# quality


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q["op7_weak_label_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    y = np.array([r.quality for r in rows])
    for column, least in (("weak_label", 0.95), ("score", 0.85)):
        s = np.array([r[column] for r in rows])
        auc = np.mean([np.mean(a > s[y == 0]) + 0.5 * np.mean(a == s[y == 0]) for a in s[y == 1]])
        assert auc >= least


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(6)
    k = len(quality.LABELLERS)
    truth = rng.random(20_000) < 0.8
    bad_rate = np.linspace(0.2, 0.8, k)
    rows = np.where(truth[:, None], np.where(rng.random((20_000, k)) < 0.01, quality.BAD, quality.NONE), np.where(rng.random((20_000, k)) < bad_rate, quality.BAD, quality.NONE))
    codes, counts = np.unique(quality.pattern(rows), return_counts=True)
    assert (quality.unpattern(quality.pattern(rows)) == rows).all()
    model = quality.LabelModel(codes, counts)
    assert ((model.posterior(quality.pattern(rows)) >= 0.5) == truth).mean() >= 0.98
    assert np.all(np.diff(model.table[:, quality.BAD, 0]) > 0)


def test_quality_equals_its_definition(spark, docs):
    """Votes, posterior and score of single texts, and EM over rows instead of patterns."""
    labels, scorer = quality.train(docs)
    rows = docs.orderBy("doc_id").limit(40).collect()
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, docs.schema), labels, scorer).collect()}
    for r in rows:
        raw = r.text.encode()
        vote = quality.votes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        good, bad = labels.prior, 1 - labels.prior
        for k, v in enumerate(vote):
            bad, good = bad * labels.table[k, v, 0], good * labels.table[k, v, 1]
        assert got[r.doc_id].weak_label == pytest.approx(good / (good + bad), abs=1e-9)
        z = scorer.bias + np.mean([float(scorer.weights[(int.from_bytes((raw[i : i + 4] + b"\0" * 3)[:4], "big") * 2654435761 % (1 << 32)) >> 16]) for i in range(len(raw))])
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
    codes, counts = quality.vote_patterns(docs)
    one, each = quality.LabelModel(codes, counts), quality.LabelModel(np.repeat(codes, counts), np.ones(counts.sum(), np.int64))
    assert one.prior == pytest.approx(each.prior) and np.allclose(one.table, each.table)


def test_quality_odd_rows(odd, empty):
    model = quality.train(odd)
    rows = quality.score(odd, *model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in rows)
    assert quality.score(empty, *quality.train(empty)).count() == 0


# chat


def test_chat_round_trip(spark):
    said = ["</s>[INST] x [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\<\\|\\", "a\\", None, "", "é😀\n\r\t", "<<SYS>>\\[INST]"]
    rows = [(c, t, ["system", "user", "assistant", None, "us\ner", "as<|sistant"][(c + t) % 6], said[(c * 3 + t) % len(said)]) for c in range(12) for t in range(c % 7 + 1)]
    rows += [(100, 1, "user", "x"), (100, 1, "user", "x"), (100, None, "assistant", "y"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat.format_chat(df).cache()
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        own = [e for e in examples.collect() if e.conv_id == c]
        assert got[c].formatted_chars == sum(len(e.formatted) for e in own)
        assert sum(e.target_turn is not None for e in own) == sum(r == "assistant" for *_, r, _ in turns)
    assert chat.read_back(chat.format_chat(df.where("1 = 0"))).count() == 0


@pytest.mark.parametrize("role", ["r" * 100_000, "\\" * 50_000, "a\n<|" * 30_000])
def test_chat_with_a_long_role(spark, role):
    df = spark.createDataFrame([(1, 0, role, "x"), (1, 1, "assistant", "y" * 3_000_000)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_chat(df)).first()
    assert (got.n_turns, got.loss_chars) == (2, 3_000_000)
    assert got.turns_sha256 == hashlib.sha256(f"{role}\nx\nassistant\n{'y' * 3_000_000}\n".encode()).hexdigest()


# licences


def test_license_base_equals_brute_force(spark):
    texts = ["GNU  General,Public-License! gnu general public license2", "the MIT license; mit\nlicense cc by-nc 4.0", None, "", "apache licenses", "x" * 5000 + " Apache License", "émit license", "CC BY cc by"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hits = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules():
    assert len(license_scan.rules()) > 300
    labels = lambda t: [d[0] for d in license_scan.Scanner().detections(t.encode())]
    assert labels("licensed under the apache license, version 2.0") == ["apache-2.0"]
    assert labels("spdx-license-identifier: gpl-3.0-or-later") == ["gpl-3.0"]
    assert labels("gnu lesser general public license v2.1 or cc by-nc-sa 4.0") == ["lgpl-2.1", "cc-by-nc-sa-4.0"]
    assert labels("released under the mit license. copyright (c) 2020 x. all rights reserved") == ["mit", "copyright", "all-rights-reserved"]
    assert labels("no such words") == []
    for r in license_scan.rules():  # a rule's keyword lets its own matches pass
        assert r.keyword


@pytest.mark.parametrize("notice", ["no part of this publication may be reproduced", "permission is hereby granted, free of charge", "permission to use, copy, modify and distribute"])
def test_license_notices_in_wrapped_text(notice):
    want = license_scan.Scanner().scan_text(notice.encode(), np.array([0]))[4:]
    for gap in ("\n", "  ", "\n * ", "\n# "):
        assert license_scan.Scanner().scan_text(notice.replace(" ", gap).encode(), np.array([0]))[4:] == want


def test_license_odd_rows(odd, empty):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == len(ODD) and max(r.n_words for r in rows) == 60_000
    assert license_scan.scan(empty).count() == 0


# pages


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in Q["op10_html_extract"](spark, SF).collect()}
    for p in pages:
        body = p.html[p.html.index("<article>") + 9 :]
        body = body[: body.rfind("</article>")] if "</article>" in body else body
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_the_tree_alone_removes_template_branches(spark):
    """Without names of elements, by entropies of content and presentation, on hosts of many pages."""
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages, by_name=False).collect()}
    noise, noise_left, text, text_left = 0, 0, 0, 0
    for p in pages.collect():
        plain = lambda x: Counter(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", x))).split())
        at, end = p.html.index("<article>"), p.html.rfind("</article>")
        article, all_ = plain(p.html[at:end]), plain(p.html)
        said = Counter(got[p.page_id].split())
        other = all_ - article
        text += article.total()
        text_left += (article & said).total()
        noise += other.total()
        noise_left += (said - article).total()
    assert text_left / text >= 0.99 and noise_left / noise <= 0.05, (text_left / text, noise_left / noise)


def test_page_parts_that_go():
    page = """<html><head><title>t</title></head><body><nav>n<article class="post"><h1>A &lt;b&gt; &amp;amp; x</h1><p>one<p>two <b>bo</b>ld<br>line
      <ul><li>i<li>j</ul><div class="share-box">s</div><form>f</form><script>if (a < b) "</p>"</script><aside>q</aside><section id="comments"><p>c</section>end</article><footer>f</footer>"""
    assert html_extract.main_text(page) == "A <b> &amp; x one two bold line i j end"
    for text in (None, "", "<", "<p", "<!-- open", "a < b", "<script>never closed", "</div></p>"):
        assert isinstance(html_extract.main_text(text), str)
    assert html_extract.main_text("<body><header>h</header><div>text</div><div class='cookie-notice'>n</div></body>") == "text"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>body</p></article><section class="comments"><article><p>reader comment</p></article></section>', "body"),
        ('<main><p>body</p><article class="comment"><p>reader</p></article><div id="post-comments-12">x</div></main>', "body"),
        ('<article><p class="ad-hoc">one</p><p id="alert-fatigue">two</p><section class="related-work">three</section></article>', "one two three"),
        ('<article><header class="article-header"><h1>Title</h1></header>text <span class="ad">buy</span>on</article>', "Title text on"),
        ("<p>E=<math><mi>m</mi><mo>+</mo></math> rest foo<img>bar a<wbr>b</p>", "E=m+ rest foobar ab"),
        ("<article><h2>card</h2></article><div><p>the text itself</p><p>goes on</p></div>", "card the text itself goes on"),
        ('<div>a<b>b<p>c</b>d</p></div><div class="site-footer">f</div><div role="search">s</div>', "ab cd"),
        ("<table><tr><td>1<td>2<tr><td>3</table><dl><dt>t<dd>d</dl>", "1 2 3 t d"),
        ("x<![CDATA[<y>]]> z&nbsp;&#233;\u2003w", "x<y> z é w"),
    ],
)
def test_pages_in_odd_markup(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>a" * 20_000, "<b>a" * 20_000, "<p><li><td>a" * 8000, "<ul><li>a" * 10_000, "<div><b>" * 8000 + "</b></div>" * 8000, '<a href="' * 20_000, "<" * 50_000, "<!--" * 20_000, "<p>a</b></i></div>" * 8000], ids=range(9))
def test_deep_and_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    html_extract.Page(page).features()
    assert time.perf_counter() - began < 3


def test_repeated_branches_go_but_copies_of_a_page_stay(spark):
    page = lambda i: f"<body><div class=top>same on all</div><div class=body>text {i}</div></body>"
    rows = [(i, f"https://A.example/{i}", page(i)) for i in range(20)] + [(i, f"https://b.example/{i}", page(0)) for i in range(20, 60)] + [(60, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "low", "path", "nodes", "page_key")})
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert {got[i] for i in range(20)} == {f"text {i}" for i in range(20)}
    assert {got[i] for i in range(20, 60)} == {"same on all text 0"} and got[60] == ""
    assert html_extract.extract(df.where("1 = 0")).count() == 0


def test_places_of_a_template_go_though_their_texts_change(spark):
    """Menus and notices of one layout go where another place varies; where none does, texts decide."""
    part = lambda i: "".join(f"<p>word{i} {k}</p>" + "<ul><li>x</ul>" * ((i + k) % 3 == 0) for k in range(i % 5 + 1))
    page = lambda i: f"<body><div class=a><a>m{i}</a></div><h1>title {i}</h1><div class=b>{part(i)}</div><div class=c>note {i}</div></body>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(12)] + [(100 + i, f"https://b.example/{i}", f"<body><div class=a>one {i}</div><div class=b>two {i}</div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"m{i}" not in got[i] and "note" not in got[i] and got[i].startswith(f"title {i} word{i} 0") for i in range(12))
    assert all(got[100 + i] == f"one {i} two {i}" for i in range(12))


def test_pages_by_join_give_the_same(spark, monkeypatch):
    rows = [(i, f"https://a.example/{i}", f"<body><div class=top>same</div><div class=body>text {i}</div></body>") for i in range(20)] + [(99, None, "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = html_extract.extract(df).collect()
    monkeypatch.setattr(html_extract, "BROADCAST_KEYS", -1)
    assert sorted(html_extract.extract(df).collect()) == sorted(one)


# workers without the package


def test_operators_run_where_workers_lack_the_package(tmp_path):
    """Only the driver can import the package: all ten queries and the pipeline still run."""
    script = tmp_path / "run.py"
    script.write_text(f"""import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / 'ck')!r}).getOrCreate()
assert spark.range(1).mapInPandas(lambda b: (x.assign(id=int("seamline" in str(__import__("importlib.util").util.find_spec("seamline")))) for x in b), "id long").first()[0] == 0
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
for name, query in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, {SF!r}).count(), flush=True)
""")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(re.findall(r"(?m)^(op\d+_\w+|pipeline) [1-9]", done.stdout)) == 11


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows, left = out.collect(), docs.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in left}
        if name == "exact_dedup":
            con.register("d", docs.toPandas())
            assert len(rows) == con.execute("SELECT count(DISTINCT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) FROM d").fetchone()[0]
        if name == "simhash_dedup":
            assert {r.doc_id for r in rows} == set(similar_heads({r.doc_id: r.text for r in left}).values())
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            held = {r.doc_id for r in left if any(" ".join(words(x)) in " ".join(words(r.text)) for x in items)}
            assert {r.doc_id for r in rows} == {r.doc_id for r in left} - held
        docs = spark.createDataFrame(rows, docs.schema)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert rows_of(["doc_id", "copy"], [tuple(r) for r in whole.select("doc_id", "copy").collect()]) == rows_of(["doc_id", "copy"], [tuple(r) for r in mixed.select("doc_id", "copy").collect()])
