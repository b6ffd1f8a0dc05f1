"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

Every benchmark item has a fingerprint over its word shingles. Documents are read in windows of
the items' sizes; a window's fingerprint is the bitwise majority of its shingles' hashes, from
running byte-wide counters. Fingerprints are cut into blocks of 16 bits: two that differ in at
most RADIUS bits differ in at most BLOCK_RADIUS bits of one block, so looking up a window's block
values with up to that many bits flipped finds all items within RADIUS. Every candidate is then
verified by exact weighted-shingle similarity (multiset Jaccard) of the best nearby stretch.

A stretch that reaches the similarity holds 0.8 of an item's shingles, so only windows with that
many shingles of any items around them have a fingerprint made. At similarity 0.8 fingerprints
differ in about 10 of 64 bits, some in more than RADIUS, and a copy may lie between the grid's
windows; so every place dense enough in one item's shingles is verified as well. Nothing that
reaches the similarity is missed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seamline.llm.common import blocks, share, shared, text_buffer
from seamline.llm.simhash import LANES, majority

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 3
#: Largest distance that the blocks guarantee.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Window sizes of one class differ by at most this factor; starts are this share of a window apart.
SIZE_STEP, STRIDE_SHARE = 1.08, 8
#: Bytes of text searched at once, so that counters stay in cache.
CHUNK = 1 << 17
#: Items that one pass over the documents holds in its index: about 1 kB each.
ITEMS_PER_PASS = 50_000
ONES = np.uint64(0x0101010101010101)
GATHER = np.uint64(0x0102040810204080)
#: Masks of at most BLOCK_RADIUS flipped bits in a block.
FLIPS = np.array([sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1) for bits in itertools.combinations(range(BLOCK_BITS), r)], np.int64)
#: Windows whose flipped block values are looked up at once.
PROBES = 1024
MARK_BITS = np.uint64((1 << 20) - 1)


def shingles(low: bytes, words: int = WORDS) -> list[int]:
    """Hashes of a lower-cased text's word shingles; of a shorter text, of its whole word sequence."""
    parts = low.split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - words + 1].tolist()
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start at `starts` and hold n numbers each."""
    return np.arange(int(n.sum())) + np.repeat(starts - np.cumsum(n) + n, n)


class SizeClass:
    """Items of nearly equal size, in shingles, with their block tables."""

    def __init__(self, items: list[int], sizes: list[int], prints: np.ndarray) -> None:
        self.items, self.prints = np.array(items), prints
        self.size = (min(sizes) + max(sizes)) // 2
        self.stride = max(1, self.size // STRIDE_SHARE)
        self.slack = self.stride + max(sizes) // 4 + max(sizes) - min(sizes) + 2
        #: Fewest item shingles of a stretch that reaches the similarity with one of the items.
        self.need = math.ceil(SIMILARITY * min(sizes) - 1e-9)
        self.tables = []
        for b in range(BLOCKS):
            value = self._block(prints, b)
            order = np.argsort(value, kind="stable")
            self.tables.append((value[order], order))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) places of all pairs within RADIUS; a pair may come more than once."""
        windows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(prints), PROBES):
            some = prints[at : at + PROBES]
            for b, (values, order) in enumerate(self.tables):
                probe = (self._block(some, b)[:, None] ^ FLIPS).ravel()
                first = np.searchsorted(values, probe)
                n = np.searchsorted(values, probe, "right") - first
                w = np.repeat(np.arange(len(probe)) // len(FLIPS), n)
                member = order[ranges(first, n)]
                close = np.bitwise_count(some[w] ^ self.prints[member]) <= RADIUS
                windows.append(at + w[close])
                items.append(member[close])
        return np.concatenate(windows), np.concatenate(items)


class Index:
    """Fingerprints, shingle multisets and size classes of benchmark items; items go by their number in `ids`."""

    def __init__(self, rows: list[tuple[Any, str]]) -> None:
        self.ids, each, short = [], [], []
        for item_id, text in rows:
            low = (text or "").encode("utf-8", "replace").lower()
            if got := shingles(low):
                self.ids.append(item_id)
                n_words = len(low.split())
                each.append(np.array(got if n_words >= WORDS else [], np.uint64))
                if n_words < WORDS:
                    short.append((n_words, got[0], len(self.ids) - 1))
        #: number of words: (hashes, items) of the items of so few words, which are found word for word.
        self.short = {k: tuple(np.array([x[j] for x in sorted(short) if x[0] == k], t) for j, t in ((1, np.uint64), (2, np.int64))) for k in sorted({x[0] for x in short})}
        self.sizes = np.array([len(h) for h in each], np.int64)
        self.need = np.ceil(SIMILARITY * self.sizes - 1e-9).astype(np.int64)
        self.longest = (self.sizes / SIMILARITY + 1e-9).astype(np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *each])
        prints = majority(every, self.sizes)
        # postings: of each distinct shingle, the items that hold it and how often
        pairs, self.held = np.unique(np.stack([every, np.repeat(np.arange(len(each)), self.sizes).astype(np.uint64)], axis=1), axis=0, return_counts=True)
        self.keys, first = np.unique(pairs[:, 0], return_index=True)
        self.first, self.item = np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
        self.marks = np.zeros(1 << 20, bool)  # low bits of all shingles
        self.marks[self.keys & MARK_BITS] = True
        self.classes, group = [], []
        for i in [*sorted((i for i, h in enumerate(each) if len(h)), key=lambda i: (len(each[i]), i)), None]:
            if group and (i is None or len(each[i]) > len(each[group[0]]) * SIZE_STEP):
                self.classes.append(SizeClass(group, [len(each[j]) for j in group], prints[group]))
                group = []
            if i is not None:
                group.append(i)

    def search(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of the best stretch of each text that holds an item;
        texts are runs of `counts` shingle hashes."""
        places = np.flatnonzero(self.marks[hashes & MARK_BITS])
        key = np.minimum(np.searchsorted(self.keys, hashes[places]), len(self.keys) - 1) if len(self.keys) else places[:0]
        known = self.keys[key] == hashes[places[: len(key)]]
        places, key = places[: len(key)][known], key[known]
        if not len(places):
            return
        ends = np.cumsum(counts)
        # (place, item, times the item has the shingle), by item and place
        n = self.first[key + 1] - self.first[key]
        at = ranges(self.first[key], n)
        by_item = np.argsort(self.item[at], kind="stable")
        at, place = at[by_item], np.repeat(places, n)[by_item]
        items, starts = np.unique(self.item[at], return_index=True)
        spots = {i: slice(a, b) for i, a, b in zip(items.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True) if b - a >= self.need[i]}
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for lo, hi, i in sorted({*self._near_windows(hashes, counts, ends, places), *self._dense(spots, place, ends)}):
            if i not in spots:
                continue
            a, b = np.searchsorted(place[spots[i]], (lo, hi)) + spots[i].start
            text = int(np.searchsorted(ends, lo, "right"))
            similarity, first = self._verify(place[a:b].tolist(), at[a:b].tolist(), i)
            if similarity >= SIMILARITY:
                option = (similarity, -(first - int(ends[text] - counts[text])))
                best[text, i] = max(best.get((text, i), option), option)
        for (text, i), (similarity, first) in sorted(best.items()):
            yield text, i, similarity, -first

    def _near_windows(self, hashes: np.ndarray, counts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(from, to, item) around the windows, and the texts shorter than a window, whose fingerprints are
        within RADIUS of an item's; only those with enough item shingles around them are looked at."""
        seen = np.zeros(len(hashes) + 1, np.int64)  # item shingles before each place
        seen[places + 1] = 1
        np.cumsum(seen, out=seen)
        begins, lanes = ends - counts, None
        begin, end = np.repeat(begins, counts), np.repeat(ends, counts)
        here = np.arange(len(hashes))
        for c in self.classes:
            grid = ((here - begin) % c.stride == 0) & (here + c.size <= end) | (here + c.size == end)
            starts = here[grid]
            starts = starts[seen[np.minimum(starts + c.size + c.slack, end[starts])] - seen[np.maximum(starts - c.slack, begin[starts])] >= c.need]
            if len(starts):
                if lanes is None:
                    lanes = np.zeros((len(hashes) + 1, 8), np.uint64)
                    np.cumsum(LANES[hashes.view(np.uint8).reshape(-1, 8)], axis=0, out=lanes[1:])
                w, i = c.near(self._prints(hashes, lanes, starts, c.size))
                s = starts[w]
                yield from zip(np.maximum(begin[s], s - c.slack).tolist(), np.minimum(end[s], s + c.size + c.slack).tolist(), c.items[i].tolist(), strict=True)
            short = np.flatnonzero((counts < c.size) & (seen[ends] - seen[begins] >= c.need))
            if len(short):
                w, i = c.near(majority(hashes[ranges(begins[short], counts[short])], counts[short]))
                yield from zip(begins[short[w]].tolist(), ends[short[w]].tolist(), c.items[i].tolist(), strict=True)

    def _dense(self, spots: dict[int, slice], place: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(from, to, item) of all places of the texts that have enough shingles of an item: a stretch that
        reaches SIMILARITY has that share of them and is at most 1 / SIMILARITY as long."""
        for i, spot in spots.items():
            p, need = place[spot], int(self.need[i])
            to = np.minimum(p + self.longest[i], ends[np.searchsorted(ends, p, "right")])
            dense = np.flatnonzero(p[need - 1 :] < to[: len(p) - need + 1])
            if len(dense):
                new = np.flatnonzero(np.concatenate(([True], p[dense[1:]] >= to[dense[:-1]])))
                for a, b in zip(dense[new].tolist(), dense[np.append(new[1:], len(dense)) - 1].tolist(), strict=True):
                    yield int(p[a]), int(to[b]), i

    def _prints(self, hashes: np.ndarray, lanes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        if size > 127:  # too many for byte-wide counters
            step = max(1, (1 << 22) // size)
            parts = [majority(hashes[(starts[i : i + step, None] + np.arange(size)).ravel()], np.full(len(starts[i : i + step]), size)) for i in range(0, len(starts), step)]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        # differences of wrapped sums are exact, as no counter of a window exceeds a byte
        sums = lanes[starts + size]
        sums -= lanes[starts]
        sums += ONES * np.uint64(127 - size // 2)
        sums >>= np.uint64(7)
        sums &= ONES
        sums *= GATHER
        return np.ascontiguousarray((sums >> np.uint64(56)).astype(np.uint8)).view(np.uint64).ravel()

    def _verify(self, places: list[int], postings: list[int], item: int) -> tuple[float, int]:
        """Best similarity of a stretch of a text, and its place, given where the item's shingles stand: of
        every stretch from one of them to another, as a longer or shorter one is less similar. A text that
        repeats an item is left at its first whole copy."""
        size, need, longest, held = int(self.sizes[item]), int(self.need[item]), int(self.longest[item]), self.held
        best = (0.0, 0)
        for n in range(len(places) - need + 1):
            a = places[n]
            if places[n + need - 1] >= a + longest:
                continue
            seen, both = {}, 0
            for place, posting in zip(places[n : n + longest], postings[n : n + longest], strict=True):
                if place >= a + longest:
                    break
                seen[posting] = seen.get(posting, 0) + 1
                if seen[posting] <= held[posting]:
                    both += 1
                    best = max(best, (both / (place + 1 - a + size - both), -a))
            if best[0] == 1.0:
                break
        return best[0], -best[1]


def item_passes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of bounded size that together hold all items; null ids and texts without words match nothing."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    passes = max(1, math.ceil(items.count() / ITEMS_PER_PASS))
    for k in range(passes):
        mine = items.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k) if passes > 1 else items
        yield Index(sorted((r.id, r.text) for r in mine.collect()))


def _found(index: Index, column: pa.Array) -> Iterator[tuple[int, int, float, int]]:
    """(row, item, similarity, first word) for a batch's texts."""
    data, offsets = text_buffer(column)
    for a, b in blocks(offsets, CHUNK):
        low = data[offsets[a] : offsets[b]].tobytes().lower()
        cuts = (offsets[a : b + 1] - offsets[a]).tolist()
        each = [shingles(low[s:e]) for s, e in itertools.pairwise(cuts)]
        hashes = np.array(list(itertools.chain.from_iterable(each)), np.uint64)
        if len(hashes):
            for text, item, similarity, at in index.search(hashes, np.array([len(x) for x in each], np.int64)):
                yield a + text, item, similarity, at
        for k, (wanted, items) in index.short.items():
            for text, (s, e) in enumerate(itertools.pairwise(cuts)):
                if len(words := low[s:e].split(None, k)) >= k and any(words):
                    said, first = np.unique(np.array(shingles(low[s:e], k), np.uint64), return_index=True)
                    place = np.minimum(np.searchsorted(said, wanted), len(said) - 1)
                    for j in np.flatnonzero(said[place] == wanted).tolist():
                        yield a + text, int(items[j]), 1.0, int(first[place[j]])


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, similarity, first_word of every document that holds a benchmark item.

    Similarity is that of the best stretch, at least SIMILARITY; first_word is where the stretch
    starts. An item of fewer than five words is found wherever its words stand consecutively. Null
    texts hold nothing. Texts of any length are read whole, and held whole in one task. Ids are of
    any type; rows that repeat an id give rows of their own. An empty table gives no rows. Other
    columns are not read.
    """
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long"
    of_item, out = to_arrow_type(benchmark.schema[item_id].dataType), None
    for index in item_passes(benchmark, item_id):
        sent = share(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = shared(sent)
            for batch in batches:
                rows = list(_found(index, batch.column(1)))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [pa.array([index.ids[r[1]] for r in rows], of_item), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "item_id", "similarity", "first_word"])

        found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item; null ids and texts stay."""
    for index in item_passes(benchmark, item_id):
        sent = share(docs.sparkSession, index)
        place = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in _found(shared(sent), batch.column(place))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
