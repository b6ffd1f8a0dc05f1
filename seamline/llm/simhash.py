"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link when they differ in at most RADIUS bits. Bits that correlate go to one group,
so that groups are nearly independent. A group g searched within threshold t(g) finds every pair
that differs in at most t(g) bits of g; when the t(g) + 1 add up to RADIUS + 1, no linked pair
escapes all groups (-1 leaves a group out). Dynamic programming picks the thresholds, and the
number of groups, by estimated candidate counts. A search within t is an equality join on the
fingerprint under each mask that leaves out t bits of the group. Buckets with too many members
are split by further masks over the bits they don't yet share, which again loses no pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import BROADCAST_KEYS, blocks, cut, hash_sample, semi, text_buffer

SEED, WORDS, RADIUS, BITS = 42, 3, 2, 64
#: Buckets of more members than this are split before any pair is compared.
BUCKET = 4096
#: A key costs about as much as this many comparisons.
KEY_COST = 300
SAMPLE = 4096
#: near_dedup links texts whose sets of shingles of so many words are 4/5 similar; op4 has WORDS and RADIUS.
COPY_WORDS = 5
#: Most hash classes of a set's sketch: smaller ones let more pairs through to the exact comparison.
MOST_CLASSES = 1 << 15
#: Shingles that so many texts of the sample share are dealt in chunks at once.
HOT = 32
#: Of its keys a row of a pair search carries so many, the smallest, so that most pairs come out under one key only.
CARRIED_KEYS = 32
#: Up to so many links are joined to components by one task: 8 MB.
TASK_LINKS = 1 << 19
#: Bytes 0..255 as eight byte-wide counters, lowest bit first.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(256, 8).copy().view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of each word shingle of a lower-cased text; a shorter text is one shingle."""
    parts = text.split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - words + 1].tolist()
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of `counts` hashes: bits set in over half of a run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
    # byte-wide counters hold 255 rows, so long runs are summed in pieces
    pieces = np.concatenate([np.arange(s, s + c, 255) for s, c in zip(starts, counts[full], strict=True)])
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], pieces, axis=0).view(np.uint8).astype(np.int64)
    totals = np.add.reduceat(lanes, np.searchsorted(pieces, starts), axis=0)
    bits = (2 * totals > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long) of every row; a text without words, or null, has fingerprint 0."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = []
            for a, b in blocks(offsets):
                low = data[offsets[a] : offsets[b]].tobytes().lower()
                cuts = (offsets[a : b + 1] - offsets[a]).tolist()
                each = [shingle_hashes(low[s:e]) for s, e in itertools.pairwise(cuts)]
                counts = np.array([len(x) for x in each], np.int64)
                out.append(majority(np.array(list(itertools.chain.from_iterable(each)), np.uint64), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def bit_correlation(fps: DataFrame, n: int) -> np.ndarray:
    """Correlation of the 64 bits over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)[at : at + 8192]).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel())], ["cell", "both"])

    both = np.zeros(BITS * BITS)
    for cell, x in fps.select("fp").mapInArrow(run, "cell int, both long").groupBy("cell").agg(F.sum("both")).collect():
        both[cell] = x
    both = both.reshape(BITS, BITS) / max(1, n)
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size, each grown from its most correlated bits."""
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = (len(left) + m - g - 1) // (m - g)
        first = max(left, key=lambda b: (sum(corr[b][x] for x in left), -b))
        group = [first]
        while len(group) < size:
            group.append(max(left - set(group), key=lambda b: (sum(corr[b][x] for x in group), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], radius: int = RADIUS) -> tuple[float, list[int]]:
    """Cheapest thresholds t >= -1 whose t + 1 add up to radius + 1; costs[g][t] of each group."""
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, radius - used + 1):
                option = (spent + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t + 1 not in step or option < step[used + t + 1]:
                    step[used + t + 1] = option
        best = step
    return best[radius + 1]


def masks_of(group: list[int], t: int) -> list[int]:
    """Masks that together find all pairs within t bits of the group."""
    return [sum(1 << b for b in group if b not in out) for out in itertools.combinations(group, t)]


def plan(fps: DataFrame, n: int) -> list[int]:
    """The masks to probe, by estimated cost. Estimates come from a bounded sample and only affect speed."""
    corr = bit_correlation(fps, n)
    some = np.array([r.fp for r in hash_sample(fps.select("fp"), "fp", SAMPLE, n, "gph").collect()], np.int64).view(np.uint64)
    pairs = max(1, len(some) * (len(some) - 1) // 2)
    options = []
    for m in (2, 3, 4):
        groups, costs = group_bits(corr, m), []
        for group in groups:
            mask, near = np.uint64(sum(1 << b for b in group)), np.zeros(RADIUS + 1)
            for i in range(len(some) - 1):
                off = np.bitwise_count((some[i + 1 :] ^ some[i]) & mask)
                near += [int((off <= t).sum()) for t in range(RADIUS + 1)]
            volume = [sum(math.comb(len(group), j) for j in range(t + 1)) / 2.0 ** len(group) for t in range(RADIUS + 1)]
            costs.append([KEY_COST * n * math.comb(len(group), t) + max(near[t] / pairs, volume[t]) * n * n / 2 for t in range(RADIUS + 1)])
        spent, chosen = allocate(costs)
        options.append((spent, [mask for group, t in zip(groups, chosen, strict=True) if t >= 0 for mask in masks_of(group, t)]))
    return min(options)[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_mask(mask: int) -> list[int]:
    """Masks that add a third of the bits still free; pairs within RADIUS agree under one of them."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[j :: RADIUS + 1]) for j in range(RADIUS + 1)]


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*(F.lit(_signed(m)).cast("long") for m in masks))
    return fps.select("fp", F.explode(keys).alias("mask")).withColumn("sig", F.col("fp").bitwiseAND(F.col("mask")))


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, for edges a-b among n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _star(fp: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, as (member, root) of each local component."""
    a, b = [], []
    stays = np.flatnonzero(run[1:] == run[:-1])
    d = 1
    while len(stays):
        close = stays[np.bitwise_count((fp[stays] ^ fp[stays + d]).view(np.uint64)) <= RADIUS]
        a.append(close)
        b.append(close + d)
        d += 1
        stays = stays[stays + d < len(run)]
        stays = stays[run[stays] == run[stays + d]]
    if not a:
        return fp[:0], fp[:0]
    root = local_roots(np.concatenate(a), np.concatenate(b), len(fp))
    out = np.flatnonzero(root != np.arange(len(fp)))
    return fp[out], fp[root[out]]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the members of each bucket; rows come sorted by key. At most BUCKET rows share one."""
    kept: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        x, y = _star(np.ascontiguousarray(rows[:, 2]), np.cumsum(new))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    for batch in batches:
        kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))
        if sum(map(len, kept)) >= 4 * BUCKET:
            rows = np.concatenate(kept)
            end = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1]) + 1 if (rows[:, :2] != rows[-1, :2]).any() else 0
            kept = [rows[end:]]
            if end:
                yield links(rows[:end])
    if kept:
        yield links(np.concatenate(kept))


def links(fps: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    found, masks, rows = None, plan(fps, n), fps
    keyed = _keyed(rows, masks)
    while True:
        hot = cut(keyed.groupBy("mask", "sig").agg(F.count("*").alias("members")).where(F.col("members") > BUCKET).select("mask", "sig"))
        n_hot = hot.count()
        cold = semi(keyed, hot, ["mask", "sig"], "left_anti", n_hot) if n_hot else keyed
        edges = cold.select("mask", "sig", "fp").repartition("mask", "sig").sortWithinPartitions("mask", "sig").mapInArrow(_probe, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not n_hot:
            return found.distinct()
        deeper = {m: [_signed(x) for x in split_mask(m & ((1 << 64) - 1))] for (m,) in hot.select("mask").distinct().collect()}
        sub = F.create_map(*(F.lit(x) for m, subs in deeper.items() for x in (F.lit(m).cast("long"), F.array(*(F.lit(s).cast("long") for s in subs)))))
        keyed = cut(semi(keyed, hot, ["mask", "sig"], "left_semi", n_hot).select("fp", F.explode(sub[F.col("mask")]).alias("mask")).withColumn("sig", F.col("fp").bitwiseAND(F.col("mask"))).distinct())


def _task_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]) for batch in batches]
    nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[local_roots(a, b, len(nodes))])], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable from each node of `edges` (a, b), which are read more than once.

    Up to TASK_LINKS edges go to one task. More take rounds of neighbours' smallest labels and of
    jumps to labels' labels, cut after each.
    """
    if edges.count() <= TASK_LINKS:
        return cut(edges.select("a", "b").coalesce(1).mapInArrow(_task_components, "node long, label long"))
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        next_ = cut(labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old")))
        # only labels that have a smaller label of their own are worth a jump; a component's root has none,
        # so the many rows that point to it need no shuffle while those few are broadcast
        moved = next_.where("new < node").select(F.col("node").alias("new"), F.col("new").alias("far"))
        heads = cut(moved.join(next_.select("new").distinct(), "new", "left_semi"))
        n_heads = heads.count()
        far = next_.join(F.broadcast(heads) if n_heads <= BROADCAST_KEYS else heads, "new", "left") if n_heads else next_.withColumn("far", F.col("new"))
        now = cut(far.select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        if now.where("label < old").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Null texts are empty and link like any other text without words. Rows that repeat an id keep
    one row each; a null id is never a component's smallest unless all its ids are null. An empty
    table gives no rows. Other columns are not read.
    """
    prints = cut(fingerprints(docs, doc_id, text))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    n = distinct.count()
    labels = components(cut(links(distinct, n)))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    heads = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = named.select("fp", "label").join(heads, "label").select("fp", "component_id")
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# near copies by exact similarity: the stage of the pipeline


def _sketch(h: np.ndarray) -> bytes:
    """Parities of a set's counts in 64 or more hash classes, three to six a member, so that few members
    share one. Halving the classes is an exclusive or of the two halves."""
    classes = min(MOST_CLASSES, max(64, 1 << (3 * len(h)).bit_length()))
    return np.packbits((np.bincount((h & np.uint64(classes - 1)).astype(np.intp), minlength=classes) & 1).astype(np.uint8)).tobytes()


def _sets(rows: DataFrame, common: np.ndarray, whole: bool) -> DataFrame:
    """Of each text of `rows` (doc_id, text_key, text) its set of COPY_WORDS shingles: node (hash of the
    set) and size; `whole`: all hashes; else its SimHash fp, its sketch and the keys under which any set
    within a similarity of 0.8 is met.

    Sets of similarity 0.8 share one of the first n - ceil(0.8 n) + 1 shingles of either under any
    common order. The order puts `common` shingles last, which affects speed, never results.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            nodes, sizes, prints, sketches, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                h = np.unique(np.array(shingle_hashes(data[offsets[i] : offsets[i + 1]].tobytes().lower(), COPY_WORDS), np.uint64))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                if not whole:
                    prints.append(majority(h, np.array([len(h)]))[0])
                    sketches.append(_sketch(h))
                    if len(late):
                        h = h[np.argsort(late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h, kind="stable")]
                    h = h[: len(h) - (4 * len(h) + 4) // 5 + 1]
                kept.append(h)
            columns = [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int64))]
            columns += [] if whole else [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, lists(kept)], names)

    names = ["doc_id", "text_key", "node", "size", *([] if whole else ["fp", "sketch"]), "hashes"]
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, node long, size long, " + ("" if whole else "fp long, sketch binary, ") + "hashes array<long>")


def _whole_runs(batches: Iterator[pa.RecordBatch], longs: int) -> Iterator[tuple[np.ndarray, list[pa.Array], bool]]:
    """Rows of `longs` long columns, sorted by the first, in pieces that end where its value changes, the
    other columns that may follow, and whether a piece ends within a run that is too long to hold."""
    kept: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, list[pa.Array]]:
        whole = pa.Table.from_batches(kept)
        return np.stack([whole.column(j).to_numpy() for j in range(longs)], axis=1), [x.combine_chunks() for x in whole.columns[longs:]]

    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= 4 * BUCKET:
            rows, more = joined()
            end = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield rows[: end or None], [x[: end or None] for x in more], end == 0
            kept = [b for b in pa.Table.from_batches(kept).slice(end or len(rows)).to_batches() if b.num_rows]
    if sum(b.num_rows for b in kept):
        yield *joined(), False


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of keys whose nodes differ in their labels; rows are key, label, node, sorted by all.

    Keys of the same nodes become one, named by a hash of the nodes. A run that is too long to hold
    keeps its key and all its rows.
    """
    inside = None
    for rows, _, cut_off in _whole_runs(batches, 3):
        rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        sizes = np.diff(np.append(starts, len(rows)))
        names = np.add.reduceat(_mixed(np.ascontiguousarray(rows[:, 2])), starts).view(np.int64)
        keep = rows[starts, 1] != rows[starts + sizes - 1, 1]
        for at, long in ((0, inside == rows[0, 0]), (-1, cut_off)):
            if long:
                names[at], keep[at] = rows[starts[at], 0], True
        inside = rows[-1, 0] if cut_off else None
        keep = np.repeat(keep, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)[keep]), pa.array(rows[keep, 2])], ["key", "node"])


def _apart(sketches: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places in which the sketches i and j differ, with as many classes as i has; j has as many or twice that."""
    data, offsets = text_buffer(sketches)
    words, at, width = data.view(np.uint64), offsets[:-1] // 8, np.diff(offsets) // 8
    out = np.zeros(len(i), np.int64)
    for w in np.unique(width[i]):
        mine = np.flatnonzero(width[i] == w)
        for s in range(0, len(mine), max(1, (1 << 20) // int(w))):
            p, span = mine[s : s + max(1, (1 << 20) // int(w))], np.arange(w)
            y = words[at[j[p], None] + span]
            twice = width[j[p]] > w
            y[twice] ^= words[at[j[p[twice]], None] + w + span]
            out[p] = np.bitwise_count(words[at[i[p], None] + span] ^ y).sum(axis=1, dtype=np.int64)
    return out


def _first_met(keys: pa.Array, key: np.ndarray):
    """A function of pairs i, j under their row's `key`: which of them share no smaller key among those
    that their rows carry (`keys`). Of all keys under which such a pair meets, one at least has it."""
    values, ends = keys.flatten().to_numpy(), np.cumsum(np.append(0, keys.value_lengths().to_numpy(zero_copy_only=False)))
    of: dict[int, frozenset] = {}

    def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for n, (x, y, k) in enumerate(zip(i.tolist(), j.tolist(), key[i].tolist(), strict=True)):
            for r in (x, y):
                if r not in of:
                    of[r] = frozenset(values[ends[r] : ends[r + 1]].tolist())
            out[n] = min(of[x] & of[y], default=k) >= k
        return out

    return first


def _candidates(forest: bool):
    """Pairs under one key that may be within a similarity of 0.8 and have different labels; `forest`: only
    as many as join all labels that such pairs join. Rows are key, size, node, label, sketch, sorted by
    the first three; unless for a `forest`, with the first of the node's keys, and a pair that meets
    under several of them comes out under the smallest.

    Sets of a and b shingles that reach it differ in at most (a + b) / 9 shingles, and parities of
    hash classes differ in no more places, so no pair that reaches it is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (sketches, *keys), _ in _whole_runs(batches, 4):
            key, size, node, label = (np.ascontiguousarray(rows[:, j]) for j in range(4))
            first = None if forest else _first_met(keys[0], key)
            # rows of one key and label are joined from the start; in a forest, found pairs join them further
            group = np.unique(rows[:, [0, 3]], axis=0, return_inverse=True)[1].ravel()
            found, d = [np.zeros((0, 2), np.int64)], 1
            stays = np.arange(len(rows) - 1)
            while len(stays):
                stays = stays[(key[stays] == key[stays + d]) & (5 * size[stays] >= 4 * size[stays + d])]
                i = stays[group[stays] != group[stays + d]]
                i = i[9 * _apart(sketches, i, i + d) <= size[i] + size[i + d]]
                i = i if forest else i[first(i, i + d)]
                found.append(np.sort(np.stack([node[i], node[i + d]], axis=1), axis=1))
                if forest and len(i):
                    group = local_roots(group[i], group[i + d], int(group.max()) + 1)[group]
                d += 1
                stays = stays[stays + d < len(rows)]
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _chunked(keys: DataFrame, forest: bool) -> DataFrame:
    """`keys` (key, node), where keys of over BUCKET nodes are split into chunks; unless for a `forest`, into
    all pairs of chunks, so that any two nodes of a key still meet."""
    hot = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET))
    n_hot = hot.count()
    if not n_hot:
        return keys
    split = keys.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key").withColumn("chunks", F.ceil(F.col("n") / BUCKET)).withColumn("mine", F.pmod(F.xxhash64("key", "node"), "chunks"))
    if forest:
        split = split.select(F.xxhash64("key", "mine").alias("key"), "node")
    else:
        met = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        split = met.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node")
    return semi(keys, hot, ["key"], "left_anti", n_hot).unionByName(split)


def _similar(pairs: DataFrame, rows: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of 0.8 at least."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = cut(prints.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key")).select("text_key").distinct())
    some = semi(rows, keys, ["text_key"], "left_semi", keys.count()).select("doc_id", "text_key", "text")
    sets = cut(_sets(some, np.zeros(0, np.uint64), True).select("node", "hashes").dropDuplicates(["node"]))
    a, b = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    # 0.8 as a fraction: shared / (x + y - shared) >= 4 / 5
    return cut(pairs.join(a, "a").join(b, "b").where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), component_id (smallest doc_id reachable) of every row,
    where texts link whose sets of COPY_WORDS shingles have a Jaccard similarity of at least 0.8.

    All such pairs link. Pairs come, first, from SimHash fingerprints of the sets within RADIUS, by
    links(). At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, so many pairs are
    further apart; the rest come by the prefix filter, size and sketch, which lose none: forests of
    them under all keys, then all pairs that are not joined by then. Every pair is verified on the
    sets themselves. Large groups of near copies mostly join in the forests, with about as many
    comparisons as they have rows.

    Null texts and texts without words are one group; a text of fewer words is one shingle. Rows
    that repeat a text share its group; a null id is never a component's smallest unless all are.
    An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    sample = hash_sample(rows, "text_key", SAMPLE // 2, rows.count(), "near")
    said = _sets(sample, np.zeros(0, np.uint64), True).select("node", F.explode("hashes").alias("h")).distinct()
    often = said.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").collect()
    common = np.sort(np.array([r.h for r in often], np.int64).view(np.uint64))
    hot = rows.sparkSession.createDataFrame([(r.h,) for r in often if r.n >= HOT], "key long")
    prints = cut(_sets(rows, common, False))
    known = cut(prints.select("node", "size", "fp", "sketch").dropDuplicates(["node"]))

    def met_by(rows: DataFrame) -> DataFrame:
        return rows.select("key", "label", "node").repartition("key").sortWithinPartitions("key", "label", "node").mapInArrow(_shared_keys, "key long, node long").distinct()

    def pairs_of(keys: DataFrame, named: DataFrame, forest: bool) -> DataFrame:
        dealt, columns = _chunked(keys, forest), ["size", "node", "label", "sketch"]
        if forest:
            dealt = dealt.join(named, "node").select("key", *columns)
        else:
            mine = dealt.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("all"))
            dealt = mine.join(named, "node").select(F.explode("all").alias("key"), *columns, F.slice("all", 1, CARRIED_KEYS).alias("keys"))
        return dealt.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(_candidates(forest), "a long, b long")

    def with_labels(keys: DataFrame, labels: DataFrame) -> DataFrame:
        return keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    keyed = prints.select(F.explode("hashes").alias("key"), "node").withColumn("label", F.col("node"))
    # a key that is known to be frequent needs no count of its nodes in one task
    met = cut(met_by(keyed.join(F.broadcast(hot), "key", "left_anti")).unionByName(keyed.join(F.broadcast(hot), "key").select("key", "node").distinct()))
    # texts of one fingerprint hang on its smallest node, and fingerprints on those they link to
    heads = cut(known.groupBy("fp").agg(F.min("node").alias("head")))
    linked = links(heads.select("fp"), heads.count()).join(heads.withColumnRenamed("fp", "a"), "a").select("b", F.col("head").alias("a")).join(heads.withColumnRenamed("fp", "b"), "b").select("a", F.col("head").alias("b"))
    alike = known.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    some = pairs_of(met, known.withColumn("label", F.col("node")), True)
    edges = _similar(cut(linked.unionByName(alike).unionByName(some).distinct()), rows, prints)
    labels = components(edges)
    rest = pairs_of(cut(met_by(with_labels(met, labels))), with_labels(known, labels), False)
    edges = edges.unionByName(_similar(cut(rest.distinct()), rows, prints))
    named = with_labels(prints.select("doc_id", "text_key", "node"), components(edges))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "label").select("doc_id", "text_key", "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near copies, by similar_groups: of each component the row with the
    smallest doc_id stays (all its rows that repeat that id do); rows with a null id stay. Rows that
    repeat an id with other texts are decided each by its own text."""
    groups = similar_groups(docs, doc_id, text)
    drop = cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key")).distinct())
    same = (docs[doc_id] == drop["drop_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == drop["drop_key"])
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_KEYS else drop, same, "left_anti")
