"""Quality by weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the
counts of all vote patterns estimates each labeller's accuracy (its votes' distribution on good and
on bad documents) and with them every pattern's posterior. A linear scorer over hashed byte grams
is trained on the posteriors of a bounded sample and scores every document.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import blocks, hash_sample, share, shared, text_buffer

#: Documents that train the scorer, at most.
FIT_DOCS = 3000
BUCKETS, GRAM = 1 << 16, 4
EM_ROUNDS, STEPS = 200, 120
#: Weight of the belief that labellers are better than chance, as a share of the rows.
PRIOR_SHARE = 0.1
NONE, GOOD, BAD = 0, 1, 2
#: Frequent words of running text in the corpus's languages (fixed values).
FUNCTION_WORDS = frozenset(
    """the of and to in is that for on with as this are by it be or an at from
    le la les de des et que une est pas pour dans qui sur du un
    der die das und von zu den mit ist nicht ein eine im dem sich auf
    el los las y que en un una por con su para del se al""".split()
)


def by_thresholds(value: np.ndarray, good: tuple[float, float], bad: tuple[float, float]) -> np.ndarray:
    """Votes: good where value is in [good), bad where it is outside [bad), else none."""
    return np.where((value >= good[0]) & (value < good[1]), GOOD, np.where((value < bad[0]) | (value >= bad[1]), BAD, NONE))


#: Of the labellers that only ever vote bad.
NEVER = (0.0, 0.0)
#: name: (good range, range outside which it is bad), on a document's measures.
LABELLERS = {
    "symbols_per_word": (NEVER, (0.0, 0.4)),
    "bars_per_word": (NEVER, (0.0, 0.15)),
    "upper_share": ((0.005, 0.2), (0.0, 0.5)),
    "repeat_share": (NEVER, (0.0, 0.2)),
    "run_share": (NEVER, (0.0, 0.2)),
    "distinct_power": (NEVER, (0.6, 1.01)),
    "function_share": ((0.06, 0.7), (0.02, 1.01)),
    "words": ((40.0, np.inf), (8.0, np.inf)),
    "word_length": (NEVER, (2.0, 14.0)),
    "sentence_length": (NEVER, (1.0, 200.0)),
    "digit_share": (NEVER, (0.0, 0.2)),
}
IS_UPPER, IS_LOWER, IS_DIGIT = (np.array([f(bytes([b])) for b in range(256)]) for f in (lambda x: x.isalpha() and x.isupper(), lambda x: x.islower() or x[0] >= 128, bytes.isdigit))
IS_SYMBOL, IS_STOP = (np.isin(np.arange(256), list(x)) for x in (rb"#$%&*|~^=+<>{}[]\@_!", b".!?"))


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The labellers' measures of each text of a block."""
    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[offsets[1:]] - total[offsets[:-1]]

    raw, cuts = data.tobytes(), offsets.tolist()
    words, repeats, runs, distinct, functions, letters_in = [], [], [], [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = raw[a:b].lower().split()
        words.append(len(w))
        repeats.append(sum(map(operator.eq, w, w[1:])))
        runs.append(max((sum(1 for _ in same) for _, same in itertools.groupby(w)), default=0) - 1 if repeats[-1] else 0)
        distinct.append(len(set(w)))
        functions.append(sum(x.strip(b".,!?") in KNOWN for x in w))
        letters_in.append(sum(map(len, w)))
    words, repeats, runs, distinct, functions, letters_in = (np.array(x, float) for x in (words, repeats, runs, distinct, functions, letters_in))
    upper, lower, digits = count(IS_UPPER[data]), count(IS_LOWER[data]), count(IS_DIGIT[data])
    some = np.maximum(words, 1)
    return {
        "symbols_per_word": count(IS_SYMBOL[data]) / some,
        "bars_per_word": count(data == ord("|")) / some,
        "upper_share": upper / np.maximum(upper + lower, 1),
        "repeat_share": repeats / some,
        "run_share": runs / some,
        "distinct_power": np.log(np.maximum(distinct, 1) + 1) / np.log(some + 1),
        "function_share": functions / some,
        "words": words,
        "word_length": letters_in / some,
        "sentence_length": words / np.maximum(count(IS_STOP[data]), 1),
        "digit_share": digits / np.maximum(upper + lower + digits, 1),
    }


KNOWN = frozenset(w.encode() for w in FUNCTION_WORDS)


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of votes for each text."""
    found = measures(data, offsets)
    return np.stack([by_thresholds(found[name], good, bad) for name, (good, bad) in LABELLERS.items()], axis=1)


def pattern(rows: np.ndarray) -> np.ndarray:
    return rows @ 3 ** np.arange(rows.shape[1])


def unpattern(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class LabelModel:
    """Prior of good and each labeller's vote distribution on bad (0) and good (1) documents."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        rows, n = unpattern(codes), counts.astype(float)
        # votes are taken to lean to the truth, with the weight of a share of the rows; EM finds by how much
        self.prior = 0.8
        start = np.tile(np.array([[0.55, 0.15, 0.3], [0.55, 0.44, 0.01]]).T, (len(LABELLERS), 1, 1))
        self.table, lean = start.copy(), PRIOR_SHARE * n.sum()
        for _ in range(EM_ROUNDS if len(rows) else 0):
            p = self.posterior(codes)
            self.prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
            weights = np.stack([n * (1 - p), n * p])
            for k in range(len(LABELLERS)):
                for v in (NONE, GOOD, BAD):
                    self.table[k, v] = (weights[:, rows[:, k] == v].sum(axis=1) + lean * start[k, v] + 0.5) / (weights.sum(axis=1) + lean + 1.5)

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability that a document with each vote pattern is good."""
        rows = unpattern(codes)
        log = np.log([1 - self.prior, self.prior]) + np.log(self.table[np.arange(len(LABELLERS)), rows]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def hashed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the byte gram that starts at each place; what lies beyond a text's end counts as zeros."""
    code = data.astype(np.uint32)
    starts, ends = np.repeat(offsets[:-1], np.diff(offsets) > 0), np.repeat(offsets[1:], np.diff(offsets) > 0)
    for j in range(1, GRAM):
        after = np.zeros(len(data), np.uint32)
        after[:-j] = data[j:]
        for i in range(j):
            after[np.maximum(ends - 1 - i, starts)[ends - 1 - i >= starts]] = 0
        code = (code << np.uint32(8)) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)


class Scorer:
    """Logistic curve of the mean weight of a text's hashed grams."""

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros(BUCKETS, np.float32), 0.0

    def fit(self, texts: list[bytes], targets: np.ndarray) -> Scorer:
        keep = [i for i, t in enumerate(texts) if t]
        if not keep:
            return self
        each = [np.unique(hashed(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])])), return_counts=True) for i in keep]
        y, size = targets[keep], np.array([len(h) for h, _ in each])
        columns = np.concatenate([h for h, _ in each])
        values = np.concatenate([c / c.sum() for _, c in each])
        starts, rows = np.cumsum(size) - size, np.repeat(np.arange(len(keep)), size)
        w, b = np.zeros(BUCKETS), 0.0
        m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for step in range(1, STEPS + 1):  # Adam over all rows
            p = 1 / (1 + np.exp(-np.clip(b + np.add.reduceat(values * w[columns], starts), -30, 30)))
            g = np.append(np.bincount(columns, values * (p - y)[rows], BUCKETS) / len(y) + 1e-7 * w, (p - y).mean())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            w, b = w - 1.0 * move[:-1], b - 0.1 * move[-1]
        self.weights, self.bias = w.astype(np.float32), float(b)
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text; an empty one gets the bias alone."""
        z, size = np.zeros(len(offsets) - 1), np.diff(offsets)
        full = np.flatnonzero(size)
        if len(full):
            z[full] = np.add.reduceat(self.weights[hashed(data, offsets)].astype(np.float64), offsets[full]) / size[full]
        return 1 / (1 + np.exp(-np.clip(self.bias + z, -30, 30)))


def vote_patterns(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(pattern, count) over all rows; at most 3 ** labellers patterns come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            codes = [pattern(votes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(offsets)]
            found, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return np.array([r.code for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[LabelModel, Scorer]:
    """Label model over all rows, scorer from at most about FIT_DOCS of them."""
    codes, counts = vote_patterns(docs, text)
    model = LabelModel(codes, counts)
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = sorted(hash_sample(known, "doc_id", FIT_DOCS, int(counts.sum()), "quality").collect(), key=lambda r: (r.doc_id, r.text))
    texts = [r.text.encode("utf-8", "replace") for r in rows]
    if not texts:
        return model, Scorer()
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    target = model.posterior(pattern(votes(np.frombuffer(b"".join(texts), np.uint8), offsets)))
    return model, Scorer().fit(texts, target)


def score(docs: DataFrame, label_model: LabelModel, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, weak_label (posterior of good), score, predicted (1 if score >= 0.5) of every row.

    Null text counts as empty. Rows that repeat an id are scored by themselves; an empty table
    gives no rows. Other columns are not read.
    """
    sent = share(docs.sparkSession, (label_model, scorer))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = shared(sent)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            weak, scores = [np.zeros(0)], [np.zeros(0)]
            for a, b in blocks(offsets):
                part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                weak.append(labels.posterior(pattern(votes(part, ends))))
                scores.append(scorer.score(part, ends))
            out = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(weak)), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "weak_label", "score", "predicted"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, weak_label double, score double, predicted int")
