"""Toxicity by compression distance.

Two zstandard dictionaries, one trained on toxic and one on ordinary text, share a common tail of
ordinary text. A window is a word with the spaces beside it (a longer run of other characters is
cut into WINDOW bytes). It is compressed between two primers from the common tail: with them the
block always compresses, never falling back to raw bytes, and the window is clear of the last
eight bytes of a frame, where zstandard starts no match. The number of bytes that the toxic
dictionary saves is the window's distance. Windows that save at least the threshold for their
length are hits. Thresholds and a logistic curve over the hits are calibrated on labelled
documents that trained neither dictionary.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import blocks, crc_fold, hash_sample, share, shared, text_buffer

#: Labelled documents a class that the fit reads at most; half train the dictionaries, half calibrate.
FIT_DOCS = 2000
GRAM, LEAST_COUNT, LEAST_RATIO, LEAST_G = 5, 3, 12.0, 18.0
#: Shares of ordinary windows that may be hits; the fit takes the one that separates documents best.
FALSE_HITS = (3e-5, 1e-4, 3e-4, 1e-3, 3e-3)
DICT_BYTES, TAIL_BYTES, PRIMER, WINDOW = 24_000, 8_000, 40, 64
CACHE = 400_000


def normalise(text: str | bytes) -> bytes:
    low = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    return (" " + " ".join(low.lower().split()) + " ").encode()


def windows(norm: bytes) -> list[bytes]:
    """Words of a normalised text; pieces of WINDOW bytes of longer ones."""
    words = norm.split()
    if len(norm) > WINDOW and any(len(w) > WINDOW for w in words):
        words = [w[i : i + WINDOW] for w in words for i in range(0, len(w), WINDOW)]
    return words


def gram_counts(texts: list[bytes]) -> tuple[Counter, int]:
    """Words that have each gram, and words in all. A word counts once between the same two
    neighbours, so that copies of a text add nothing."""
    seen: set[int] = set()
    counts: Counter = Counter()
    for t in texts:
        words = [b"", *windows(t), b""]
        for i in range(1, len(words) - 1):
            if (key := hash((words[i - 1], words[i], words[i + 1]))) not in seen:
                seen.add(key)
                counts.update(grams(words[i]))
    return counts, max(1, len(seen))


def grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}


def g_test(c: int, n: int, d: int, m: int) -> float:
    """Log-likelihood ratio that c of n and d of m come from different rates."""
    rate = (c + d) / (n + m)
    return 2 * sum(x * math.log(x / (k * rate)) for x, k in ((c, n), (d, m)) if x)


def train_dictionary(texts: list[bytes], others: list[bytes], contrast: bool, size: int) -> bytes:
    """Dictionary content for `texts`: its most frequent words, the most frequent last, where
    offsets are short. With contrast, only words with a gram that is significantly more frequent
    in `texts` than in `others`."""
    (have, n), (other, m) = gram_counts(texts), gram_counts(others)
    strong = lambda c, d: (c + 0.5) / n >= LEAST_RATIO * (d + 0.5) / m and g_test(c, n, d, m) >= LEAST_G
    good = {g for g, c in have.items() if c >= LEAST_COUNT and (not contrast or strong(c, other[g]))}
    seen = Counter(w for t in texts for w in windows(t))
    seen = Counter({w: c for w, c in seen.items() if not good.isdisjoint(grams(w))})
    chosen, total = [], 0
    for w, _ in sorted(((w, c) for w, c in seen.items() if c > 1 or contrast), key=lambda x: (-x[1], x[0])):
        total += len(w) + 2
        if total > size:
            break
        chosen.append(b" " + w + b" ")
    return b"".join(reversed(chosen))


class Model:
    """Two dictionaries, a threshold for each length of a window and a logistic curve (bias, weights)."""

    def __init__(self, ordinary: bytes, toxic: bytes, tail: bytes) -> None:
        self.parts = (ordinary, toxic, tail)
        self.thresholds, self.curve = [1] * (WINDOW + 1), (-4.0, 1.0, 1.0, 1.0)
        self._made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def compressors(self) -> tuple[zs.ZstdCompressor, zs.ZstdCompressor, dict[bytes, int]]:
        if self._made is None:
            ordinary, toxic, tail = self.parts
            pad = b"\n" * 64  # the first bytes of a dictionary are no match candidates
            p = zs.ZstdCompressionParameters.from_level(
                19, source_size=128, dict_size=1 << 16, hash_log=17, chain_log=17, search_log=6, min_match=3, strategy=zs.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            made = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(pad + c + tail, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=p) for c in (ordinary, toxic)]
            self._made = (*made, {})
        return self._made

    def distances(self, norm: bytes) -> list[int]:
        """Bytes that the toxic dictionary saves, for each window."""
        ordinary, toxic, cache = self.compressors()
        found = windows(norm)
        for w in found:
            if w not in cache:
                if len(cache) >= CACHE:
                    cache.clear()
                    return self.distances(norm) if len(found) < CACHE else [self.distance(x) for x in found]
                cache[w] = self.distance(w)
        return [cache[w] for w in found]

    def distance(self, window: bytes) -> int:
        ordinary, toxic, _ = self.compressors()
        tail = self.parts[2]
        data = tail[-PRIMER:] + b" " + window + b" " + tail[:PRIMER]
        return len(ordinary.compress(data)) - len(toxic.compress(data))

    def features(self, norm: bytes) -> tuple[float, float, float]:
        """Logarithms of the hits, the hits per hundred windows and what hits save over their thresholds."""
        saved = self.distances(norm)
        over = [x - t for w, x in zip(windows(norm), saved, strict=True) if x >= (t := self.thresholds[len(w)])]
        return math.log1p(len(over)), math.log1p(100.0 * len(over) / max(1, len(saved))), math.log1p(sum(over))

    def score(self, text: str | bytes) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(normalise(text)), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Newton's method; (weights with the bias first, loss)."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(rows: list[tuple[str, int]]) -> Model:
    """Model from (text, label 0/1) rows; without both labels every score is 0."""
    toxic, ordinary = ([normalise(t) for t, y in rows if y == k] for k in (1, 0))
    if len(toxic) < 2 or len(ordinary) < 2:
        model = Model(b"", b"", b" " * 2 * PRIMER)
        model.curve = (-50.0, 0.0, 0.0, 0.0)
        return model
    learn_t, learn_o = toxic[::2], ordinary[::2]
    tail = b"".join(learn_o)[:TAIL_BYTES].rjust(2 * PRIMER)
    bad = train_dictionary(learn_t, learn_o, True, DICT_BYTES)
    model = Model(train_dictionary(learn_o, learn_t, False, DICT_BYTES), bad, tail)
    held = [(t, 1) for t in toxic[1::2]] + [(t, 0) for t in ordinary[1::2]]
    y = np.array([k for _, k in held], float)
    saved = [Counter() for _ in range(WINDOW + 1)]
    for t in ordinary[1::2]:
        for w, x in zip(windows(t), model.distances(t), strict=True):
            saved[len(w)][x] += 1
    best, found = math.inf, None
    for rate in FALSE_HITS:
        model.thresholds = [threshold(c, rate) for c in saved]
        w, loss = logistic(np.array([model.features(t) for t, _ in held]), y)
        if loss < best - 1e-9:
            best, found = loss, (model.thresholds, tuple(map(float, w)))
    model.thresholds, model.curve = found
    return model


def threshold(saved: Counter, rate: float) -> int:
    """Least distance, 2 at least, that at most `rate` of ordinary windows of one length reach."""
    total, tail = sum(saved.values()), 0
    for x in sorted(saved, reverse=True):
        tail += saved[x]
        if tail > rate * total:
            return max(2, x + 1)
    return 2


def training_rows(docs: DataFrame, labels: DataFrame, folds: int | None = None, held: int = 1, most: int = FIT_DOCS) -> list[tuple[str, int]]:
    """At most about `most` labelled texts a class, chosen by a hash of the id; rows whose
    crc_fold() is `held` are left out. Null labels and ids don't count; a document labelled both
    ways counts as toxic."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if folds:
        known = known.where(crc_fold(F.col("doc_id"), folds) != held)
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [hash_sample(known.where(F.col("toxic") == k), "doc_id", most, n, "toxicity") for k, n in sorted(sizes.items())]
    if not parts:
        return []
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return [(r.text, r.toxic) for r in sorted(texts.collect(), key=lambda r: (r.doc_id, r.text))]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and toxicity score of every row; null counts as empty, and an empty text has no hits.

    A text of any length is read whole, a word at a time. Rows that repeat an id are scored each by
    its own text; an empty table gives no rows. Other columns are not read.
    """
    sent = share(docs.sparkSession, model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = []
            for a, b in blocks(offsets):
                part = data[offsets[a] : offsets[b]].tobytes()
                ends = (offsets[a : b + 1] - offsets[a]).tolist()
                out += [model.score(part[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", reject: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below `reject`; null texts stay, and each
    row is decided by its own text."""
    sent = share(docs.sparkSession, model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(place))
            keep = [shared(sent).score(data[s:e].tobytes()) < reject for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
