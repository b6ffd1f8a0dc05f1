"""Language identification by prediction by partial matching.

For each language, a tree of byte contexts of order 0 to ORDER holds symbol counts from a bounded
sample. A symbol's code length in a context is -log2(c / (n + q)) where it was seen (n symbols, q
distinct ones), else the escape's -log2(q / (n + q)) plus its length in the next shorter context,
down to equal shares of the alphabet. Statistics are frozen after training and none is pruned, so
a text's exact code length is a sum over its (context, symbol) pairs; the lengths of the distinct
pairs of a block of texts are worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import blocks, crc_fold, share, shared, text_buffer

#: The fit's sample: about so many documents a language at most, none of more characters than FIT_CHARS.
FIT_DOCS, FIT_CHARS = 400, 100_000
ORDER = 3
UNKNOWN = "und"
#: A-Z to a-z, digits to one digit, white space to one blank; other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[[9, 10, 11, 12, 13]] = 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = True


class Tree:
    """One language's contexts and (context, symbol) pairs of each order, sorted, with their code lengths."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.size, self.orders = size, []
        for k in range(ORDER + 1):
            context = np.zeros(len(symbols) - ORDER, np.int64)
            for j in range(k, 0, -1):
                context = context * size + symbols[ORDER - j : len(symbols) - j]
            pairs, c = np.unique(context * size + symbols[ORDER:], return_counts=True)
            known, place, q = np.unique(pairs // size, return_inverse=True, return_counts=True)
            n = np.bincount(place, c, len(known))
            self.orders.append((known, np.log2((n + q) / q), pairs, np.log2((n + q)[place] / c)))

    def lengths(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of each symbol after its context of ORDER symbols."""
        out, left = np.zeros(len(context)), np.arange(len(context))
        for k in range(ORDER, -1, -1):
            known, escape, pairs, bits = self.orders[k]
            if not len(known):
                continue
            here = context[left] % self.size**k
            code = here * self.size + symbol[left]
            at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
            seen = pairs[at] == code
            out[left[seen]] += bits[at[seen]]
            left, here = left[~seen], here[~seen]
            at = np.minimum(np.searchsorted(known, here), len(known) - 1)
            out[left] += np.where(known[at] == here, escape[at], 0.0)
        out[left] += np.log2(self.size)
        return out


class Model:
    """Languages, byte classes and a context tree a language."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(samples)
        streams = {lang: np.concatenate([FOLD[np.frombuffer((" " * ORDER + t).encode("utf-8", "replace"), np.uint8)] for t in texts]) for lang, texts in samples.items()}
        used = np.unique(np.concatenate([*streams.values(), np.frombuffer(b" ", np.uint8)]))
        self.classes = np.zeros(256, np.int64)  # class 0: bytes not seen in training
        self.classes[used] = np.arange(1, len(used) + 1)
        self.size = len(used) + 1
        self.trees = [Tree(self.classes[streams[lang]], self.size) for lang in self.langs]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (row) under each language (column)."""
        out = np.zeros((len(offsets) - 1, max(1, len(self.langs))))
        x = self.classes[FOLD[data]]
        blank, starts = int(self.classes[32]), offsets[:-1]
        code = np.zeros(len(x), np.int64)
        for j in range(ORDER, 0, -1):
            before = np.full(len(x), blank, np.int64)
            before[j:] = x[:-j]
            for i in range(j):  # places whose j-th predecessor would be in another text
                at = starts + i
                before[at[at < len(x)]] = blank
            code = code * self.size + before
        code = code * self.size + x
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            each, place = self._distinct(code)
            for j, tree in enumerate(self.trees):
                out[full, j] = np.add.reduceat(tree.lengths(each // self.size, each % self.size)[place], starts[full])
        return out

    def _distinct(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes, and each code's place among them."""
        most = self.size ** (ORDER + 1)
        if most > 1 << 28:
            return np.unique(code, return_inverse=True)
        there = np.zeros(most, bool)
        there[code] = True
        each = np.flatnonzero(there)
        place = np.empty(most, np.int32)  # only the places of codes that are there are written and read
        place[each] = np.arange(len(each), dtype=np.int32)
        return each, place[code]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    plain = np.concatenate(([0], np.cumsum(IS_LETTER[FOLD[data]])))
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def training_texts(docs: DataFrame, folds: int | None = None, held: int = 2, most: int = FIT_DOCS) -> dict[str, list[str]]:
    """About `most` texts a language at most, chosen by a hash of id and text, none longer than
    FIT_CHARS; rows without text, lang or id, and rows whose crc_fold() is `held`, are left out.

    Languages are counted in one pass and texts chosen in another, however many languages there
    are. An empty table gives no language.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    if folds:
        known = known.where(crc_fold(F.col("doc_id"), folds) != held)
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share_of = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, most / n)))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("langid"), F.col("doc_id").cast("string"), F.lit(":"), F.xxhash64("text").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    out: dict[str, list[str]] = {}
    for r in sorted(known.where((F.length("text") <= FIT_CHARS) & (u < share_of[F.col("lang")])).collect(), key=lambda r: (r.lang, r.doc_id, r.text)):
        out.setdefault(r.lang, []).append(r.text)
    return out


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row.

    score is the share of the predicted language when all are equally likely beforehand. A text
    that is null or has no letter, and any text when no language was learned, is `und` with
    score 0. Ties go to the alphabetically first language. A text of any length is read whole. Rows
    that repeat an id are predicted each by its own text; an empty table gives no rows. Other
    columns are not read.
    """
    sent = share(docs.sparkSession, model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            langs, scores = [], []
            for a, b in blocks(offsets):
                part, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                bits = model.code_lengths(part, ends)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(0, bits.min(axis=1)[:, None] - bits)).sum(axis=1)
                known = has_letter(part, ends) & bool(model.langs)
                langs += [model.langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                scores.append(np.where(known, share, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
