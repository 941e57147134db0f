"""Exact n-gram Jaccard join: components of documents whose shingle sets are alike.

Two sets link when 100 * |x & y| >= percent * |x | y|. Equal sets are one class from the
start (a 128-bit sum over the set names it), so copies never meet each other. What
follows is exact for the rest and never makes all pairs of a group:

1. *Prefixes, rarest shingles first.* A set of n shingles that may miss at most M of them
   shares one of any M + 1 with every partner. Shingles are counted over distinct sets
   (packed per task and bucket, so a shuffle moves arrays); one that stands in a single
   set is nobody's partner and comes first, so a set with more than M of those links with
   nothing. A first count covers a fixed share of all hash values (``UNIVERSE``) and
   drops most sets; the sets that stay are counted again in full.
2. *Index lists, skipped in blocks by position.* A list holds the sets with a shingle in
   their prefix, by size, with the position of the shingle. Partners must be close enough
   in size and both early enough in position; blocks in which no set can be are skipped,
   and only which sets hang together is kept, not pairs. That gives clusters.
3. *Answers from similar sets.* In a cluster the overlaps of a set with all others are
   counted over the lists of its shingles or, from the overlaps of a similar set done
   before, over the lists of only those shingles in which the two differ. Sets that hang
   together already aren't compared any more.
4. Clusters beyond ``BLOCK_SHINGLES`` are dealt out to blocks. After each block has been
   joined in itself, and a few members of each part with those of other blocks, only the
   sets outside the largest part of the cluster visit the other blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read, small, stored
from tessera.llm.kernels import SPACE_WORDS, mix, shingles, tidied, word_chunks

WORDS, PERCENT = 5, 80
#: Share of the hash values that the first count covers.
UNIVERSE = 0.45
#: Shingles of sets that one task of the verification holds; packed arrays of a task before they are passed on.
BLOCK_SHINGLES, FLUSH = 2_000_000, 1_500_000
#: Members of each part that a block sends to meet those of other blocks.
ENVOYS = 32

_U = np.uint64
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def _most_missing(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its n shingles a set may miss in a partner."""
    return n - (percent * n + 99) // 100


# ---------------------------------------------------------------- sets

def _signature(unique: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        n = _U(len(unique))
        return (int(mix(mix(unique + _U(0x51ED270B0B4CF1C5)).sum(dtype=np.uint64) + n)),
                int(mix(mix(unique ^ _U(0xA24BAED4963EE407)).sum(dtype=np.uint64) ^ (n * _U(0x9E3779B97F4A7C15)))))


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for lo, hi, h, counts in word_chunks(column, SPACE_WORDS):
        all_, n = shingles(h, counts, words)
        ends = np.cumsum(n)
        for i in range(hi - lo):
            s = np.sort(all_[ends[i] - n[i] : ends[i]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield lo + i, s


def _as_long(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _describe(words: int, with_set: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, n, hi, lo[, shingles]) of every row; an empty set has n 0 and no name."""
    for batch in batches:
        n, hi, lo = (np.zeros(batch.num_rows, np.uint64) for _ in range(3))
        sets: list = [None] * batch.num_rows
        for i, s in _sets(batch.column(0), words):
            if len(s):
                n[i], (hi[i], lo[i]) = len(s), _signature(s)
            if with_set:
                sets[i] = s.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), _as_long(n), _as_long(hi), _as_long(lo), *([pa.array(sets, pa.binary())] if with_set else [])],
            ["_id", "n", "hi", "lo", *(["shingles"] if with_set else [])])


# ---------------------------------------------------------------- packed postings

class _Packs:
    """Arrays of postings per bucket, given out as rows (bucket, kind, parts) when they are large enough."""

    schema = "bucket int, kind int, keys binary, sizes binary, tokens binary, owners binary, extra binary"

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.keys: list = []
        self.sizes: list = []
        self.tokens: list = []
        self.lengths: list = []
        self.total = 0

    def row(self, bucket: int, kind: int, keys, sizes, tokens=b"", owners=b"", extra=b"") -> pa.RecordBatch:
        values = [x if isinstance(x, bytes) else x.tobytes() for x in (keys, sizes, tokens, owners, extra)]
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([v], pa.binary()) for v in values)],
            ["bucket", "kind", "keys", "sizes", "tokens", "owners", "extra"])

    def add(self, key: tuple[int, int], n: int, posted: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append((n, len(posted)))
        self.tokens.append(posted)
        self.total += len(posted) + 8

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        keys = np.array(self.keys, dtype=_KEY)
        sizes = np.array(self.sizes, dtype=np.uint32)
        home = (keys["hi"] % _U(self.buckets)).astype(np.int64)
        for b in np.unique(home).tolist():
            at = home == b
            yield self.row(b, 1, keys[at], sizes[at])
        tokens = np.concatenate(self.tokens)
        owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(t) for t in self.tokens])
        bucket = (mix(tokens) % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                own, local = np.unique(owner[at], return_inverse=True)
                yield self.row(b, 0, keys[own], b"", tokens[at], local.astype(np.uint32))
        self.__init__(self.buckets)


def _post(source, buckets: int, percent: int, universe: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of every distinct set of a task: its shingles of the universe, or M + 1 if it has fewer there."""
    packs, seen = _Packs(buckets), set()
    limit = _U(min(int(universe * 2.0**64), 2**64 - 1))
    for key, s in source(batches):
        if key in seen or not len(s):
            continue
        seen.add(key)
        inside = len(s) if universe >= 1 else int(np.searchsorted(s, limit))
        packs.add(key, len(s), s[: max(inside, int(_most_missing(np.int64(len(s)), percent)) + 1)])
        if packs.total > FLUSH:
            yield from packs.flush()
            if len(seen) > 2_000_000:
                seen.clear()  # a set that is posted twice is dropped again at its bucket
    yield from packs.flush()


def _text_source(words: int):
    def source(batches):
        for batch in batches:
            for _, s in _sets(batch.column(0), words):
                if len(s):
                    yield _signature(s), s
    return source


def _set_source(batches):
    """Rows (k, shingles): the key is the number of the set."""
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield (k, 0), np.frombuffer(raw.as_buffer(), np.uint64)


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], list[tuple]]:
    """(bucket, kind): its packs."""
    rows: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(7)]
        for bucket, kind, *parts in zip(*cols):
            rows[bucket, kind].append(parts)
    return rows


def _joined(packs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and tokens, owners (numbers of keys) and extras of all packs."""
    keys, tokens, owners, extra, base = [], [], [], [], 0
    for k, _, t, o, x in packs:
        keys.append(np.frombuffer(k, _KEY))
        tokens.append(np.frombuffer(t, np.uint64))
        owners.append(np.frombuffer(o, np.uint32).astype(np.int64) + base)
        extra.append(np.frombuffer(x, np.uint32))
        base += len(keys[-1])
    unique, number = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.concatenate(tokens), number[np.concatenate(owners)], np.concatenate(extra)


def _shared(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From buckets of shingles to buckets of sets: the shingles that stand in two sets or more, with their counts."""
    packer = _Packs(buckets)
    for (bucket, kind), packs in _gather(batches).items():
        if kind == 1:
            for keys, sizes, *_ in packs:
                yield packer.row(bucket, 1, keys, sizes)
            continue
        keys, tokens, owners, _ = _joined(packs)
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        once = np.ones(len(tokens), bool)
        once[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
        tokens, owners = tokens[once], owners[once]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(first, len(tokens)))
        counts = np.repeat(counts, counts)
        keep = counts > 1
        tokens, owners, counts = tokens[keep], owners[keep], counts[keep].astype(np.uint32)
        home = (keys["hi"] % _U(buckets)).astype(np.int64)[owners]
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(buckets + 1))
        for b in range(buckets):
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                own, local = np.unique(owners[at], return_inverse=True)
                yield packer.row(b, 0, keys[own], b"", tokens[at], local.astype(np.uint32), counts[at])


def _prefixes(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that may have a partner: (hi, lo, n, prefix tokens that others have, their positions)."""
    rows = _gather(batches)
    for bucket in {b for b, _ in rows}:
        sizes: dict[tuple[int, int], tuple[int, int]] = {}
        for keys, raw, *_ in rows.get((bucket, 1), ()):
            for key, size in zip(np.frombuffer(keys, _KEY).tolist(), np.frombuffer(raw, np.uint32).reshape(-1, 2).tolist()):
                sizes[key] = size
        if (bucket, 0) not in rows:
            continue
        keys, tokens, owners, counts = _joined(rows[bucket, 0])
        n, posted = np.array([sizes[k] for k in keys.tolist()], np.int64).T
        order = np.lexsort((tokens, counts, owners))
        tokens, owners = tokens[order], owners[order]
        shared = np.bincount(owners, minlength=len(keys))
        unique = posted - shared
        need = _most_missing(n, percent) + 1 - unique
        place = np.arange(len(owners)) - (np.cumsum(shared) - shared)[owners]
        keep = place < need[owners]
        tokens, owners, place = tokens[keep], owners[keep], (place + unique[owners])[keep]
        ends = np.searchsorted(owners, np.arange(len(keys) + 1))
        live = np.flatnonzero(need > 0)
        yield pa.RecordBatch.from_arrays(
            [_as_long(keys["hi"][live]), _as_long(keys["lo"][live]), pa.array(n[live]),
             pa.array([tokens[ends[i] : ends[i + 1]].tobytes() for i in live], pa.binary()),
             pa.array([place[ends[i] : ends[i + 1]].astype(np.uint32).tobytes() for i in live], pa.binary())],
            ["hi", "lo", "n", "tokens", "places"])


def prefixes(rows: DataFrame, source, percent: int, universe: float) -> DataFrame:
    buckets = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    posted = rows.mapInArrow(lambda it: tidied(_post(source, buckets, percent, universe, it)), _Packs.schema)
    shared = posted.repartitionById(buckets, "bucket").mapInArrow(lambda it: tidied(_shared(buckets, it)), _Packs.schema)
    return shared.repartitionById(buckets, "bucket").mapInArrow(
        lambda it: tidied(_prefixes(percent, it)), "hi long, lo long, n long, tokens binary, places binary")


# ---------------------------------------------------------------- index lists

def _lists_out(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (set, size, place) packed by bucket of their shingle."""
    packer = _Packs(buckets)
    for batch in batches:
        k, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint32)
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
        if not tokens:
            continue
        places = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3)])
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        tokens = np.concatenate(tokens)
        bucket = (mix(tokens ^ _U(0x1234567)) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                yield packer.row(b, 0, k[owner[at]], n[owner[at]], tokens[at], b"", places[at])


def _hang_together(n: np.ndarray, reach: np.ndarray, percent: int, block: int = 64) -> Iterator[tuple[int, int]]:
    """Star edges (by index) of the sets of one list that some chain of possible partners connects.

    ``reach`` is (100 + percent) * (n - place) - percent * n: x and y may link when
    reach[x] >= percent * n[y] and reach[y] >= percent * n[x]. Entries are in order of size.
    """
    size = len(n)
    cost = percent * n
    left = np.ones(size, bool)
    best = np.maximum.reduceat(reach, np.arange(0, size, block))
    for root in range(size):
        if not left[root]:
            continue
        left[root] = False
        work = [root]
        while work:
            x = work.pop()
            end = int(np.searchsorted(cost, reach[x], side="right"))
            if not end:
                continue
            if end <= 4 * block:
                y = np.flatnonzero(left[:end] & (reach[:end] >= cost[x]))
            else:
                blocks = np.flatnonzero(best[: (end + block - 1) // block] >= cost[x])  # the others are skipped
                y = (blocks[:, None] * block + np.arange(block)[None, :]).ravel()
                y = y[y < end]
                y = y[left[y] & (reach[y] >= cost[x])]
            left[y] = False
            for j in y.tolist():
                yield root, j
                work.append(j)


def _candidates(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between sets of a list that may link, directly or in a chain."""
    for _, packs in _gather(batches).items():
        k = np.concatenate([np.frombuffer(p[0], np.uint64) for p in packs])
        n = np.concatenate([np.frombuffer(p[1], np.uint32) for p in packs]).astype(np.int64)
        tokens = np.concatenate([np.frombuffer(p[2], np.uint64) for p in packs])
        places = np.concatenate([np.frombuffer(p[4], np.uint32) for p in packs]).astype(np.int64)
        reach = (100 + percent) * (n - places) - percent * n
        order = np.lexsort((n, tokens))
        k, n, tokens, reach = k[order], n[order], tokens[order], reach[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        length = np.diff(np.append(first, len(tokens)))
        pairs = []
        two = first[length == 2]
        ok = (reach[two] >= percent * n[two + 1]) & (reach[two + 1] >= percent * n[two])
        pairs.append(np.stack([k[two[ok]], k[two[ok] + 1]], axis=1))
        for at, size in zip(first[length > 2].tolist(), length[length > 2].tolist()):
            cut = slice(at, at + size)
            found = list(_hang_together(n[cut], reach[cut], percent))
            if found:
                pairs.append(k[cut][np.array(found)])
        edges = np.concatenate(pairs)
        edges = np.unique(np.sort(edges.view(np.int64), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 1].copy()), pa.array(edges[:, 0].copy())], ["a", "b"])


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every end of an edge (a, b): root is the smallest number that it hangs together with.

    Large-star and small-star steps in turn: every vertex points its larger, then its
    smaller neighbours at the smallest one, until nothing changes.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b")  # at most a row an edge; equal ones go with the small star's
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        both = large.join(low, "a")
        now = stored(both.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .union(both.select("a", F.col("m").alias("b"))).distinct())
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (new["n"], new["s"]) == mark:
            break
        mark = (new["n"], new["s"])
    return now.select("a", F.col("b").alias("root")).union(now.select(F.col("b").alias("a"), F.col("b").alias("root"))).distinct()


class _Parts:
    """Union-find over sets; parts may be joined from the start by their labels."""

    def __init__(self, labels: np.ndarray) -> None:
        _, self.of = np.unique(labels, return_inverse=True)
        self.count = int(self.of.max()) + 1 if len(labels) else 0
        order = np.argsort(self.of, kind="stable")
        edges = np.searchsorted(self.of[order], np.arange(self.count + 1))
        self.members = {p: order[edges[p] : edges[p + 1]] for p in range(self.count)}

    def join(self, i: int, others: np.ndarray) -> None:
        parts = np.unique(np.append(self.of[others], self.of[i]))
        if len(parts) == 1:
            return
        keep = max(parts.tolist(), key=lambda p: len(self.members[p]))
        gone = [p for p in parts.tolist() if p != keep]
        for p in gone:
            self.of[self.members[p]] = keep
        self.members[keep] = np.concatenate([self.members[keep], *(self.members.pop(p) for p in gone)])
        self.count -= len(gone)


def verify(sets: list[np.ndarray], labels: np.ndarray, percent: int, asks: np.ndarray | None = None) -> np.ndarray:
    """Part numbers after joining all sets that link; sets with equal labels are joined from the start.

    With ``asks``, only links of those sets to the others (at home) are looked for.
    """
    size = len(sets)
    parts = _Parts(labels)
    if parts.count <= 1:
        return parts.of
    n = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    of = [tokens[e - c : e] for e, c in zip(ends, n)]
    holder = np.repeat(np.arange(size), n)
    order = np.argsort(tokens, kind="stable")
    holder = holder[order]
    edges = np.searchsorted(tokens[order], np.arange(int(tokens.max()) + 2))

    def counted(which: np.ndarray) -> np.ndarray:
        if not len(which):
            return np.zeros(size, np.int64)
        return np.bincount(np.concatenate([holder[edges[t] : edges[t + 1]] for t in which.tolist()]), minlength=size)

    weight = np.diff(edges)
    todo = np.ones(size, bool) if asks is None else asks.copy()
    base, answers = -1, None  # a set that was done before and its overlaps with all
    while parts.count > 1:
        if asks is None:  # whoever is outside the largest part asks, so its own sets needn't
            done = max(parts.members, key=lambda p: len(parts.members[p]))
        else:  # sets at home never ask: one that asks has nothing to find only if all of them are in its part
            home = np.unique(parts.of[~asks])
            done = int(home[0]) if len(home) == 1 else -1
        open_ = np.flatnonzero(todo & (parts.of != done))
        if not len(open_):
            break
        if base >= 0:  # most similar to the last one first: its answers need the fewest changes
            x = int(open_[np.argmin(n[open_] + n[base] - 2 * answers[open_])])
        else:
            x = int(open_[0])
        todo[x] = False
        if base >= 0 and n[x] + n[base] - 2 * answers[x] < n[x]:
            new, old = np.setdiff1d(of[x], of[base], assume_unique=True), np.setdiff1d(of[base], of[x], assume_unique=True)
            if weight[new].sum() + weight[old].sum() < weight[of[x]].sum():
                overlap = answers + counted(new) - counted(old)
            else:
                overlap = counted(of[x])
        else:
            overlap = counted(of[x])
        base, answers = x, overlap
        linked = np.flatnonzero(100 * overlap >= percent * (n[x] + n - overlap))
        parts.join(x, linked)
    return parts.of


def _verify_groups(percent: int, visitors: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between parts of each group; rows come group by group."""
    held: tuple | None = None
    rows: list[tuple] = []

    def done() -> pa.RecordBatch:
        labels = np.array([r[1] for r in rows], np.int64)
        of = verify([r[2] for r in rows], labels, percent, np.array([r[3] for r in rows], bool) if visitors else None)
        out = {}
        order = np.argsort(labels, kind="stable")
        first: dict[int, int] = {}
        for i in order.tolist():  # the smallest label of a part is its root
            root = first.setdefault(int(of[i]), int(labels[i]))
            out[int(labels[i]), root] = None
        a, b = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        cluster, block, k, label, ask = (batch.column(i).to_pylist() for i in range(5))
        for i, raw in enumerate(batch.column(5)):
            group = cluster[i], block[i]
            if group != held and rows:
                yield done()
                rows = []
            held = group
            rows.append((k[i], label[i], np.frombuffer(raw.as_buffer(), np.uint64), ask[i]))
    if rows:
        yield done()


def _verified(rows: DataFrame, percent: int, visitors: bool = False) -> DataFrame:
    """Edges between labels for rows (cluster, block, k, label, ask, shingles)."""
    cols = ["cluster", "block", "k", "label", "ask", "shingles"]
    dealt = rows.select(*cols).repartition("cluster", "block").sortWithinPartitions("cluster", "block", "k")
    return dealt.mapInArrow(lambda it: tidied(_verify_groups(percent, visitors, it)), "a long, b long")


def _dealt(rows: DataFrame, name: str, block_shingles: int, seed: int) -> DataFrame:
    """``rows`` with a column ``name`` that deals each cluster's sets out, ``block_shingles`` to a number on average."""
    need = rows.groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("_need"))
    return rows.join(small(stored(need)), "cluster").withColumn(name, F.pmod(F.xxhash64("k", F.lit(seed)), F.col("_need")).cast("int")).drop("_need")


def linked(sets: DataFrame, clusters: DataFrame, percent: int, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, root): components of the sets (k, n, shingles) of clusters (a, root)."""
    rows = sets.join(clusters.select(F.col("a").alias("k"), F.col("root").alias("cluster")), "k")
    sizes = sets.select("k", "n").join(clusters.withColumnRenamed("a", "k"), "k").groupBy(F.col("root").alias("cluster")).agg(
        F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    sizes = stored(sizes)
    rows = rows.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    own = rows.withColumn("label", F.col("k")).withColumn("ask", F.lit(True))
    edges = stored(_verified(own, percent))
    if not sizes.filter("blocks > 1").limit(1).count():
        return components(edges)
    # clusters of several blocks: parts, then envoys of parts, then whoever is outside the largest part
    large = stored(rows.filter("blocks > 1"))

    def labelled(found: DataFrame) -> DataFrame:
        return large.join(found.select(F.col("a").alias("k"), F.col("root").alias("label")), "k", "left").withColumn(
            "label", F.coalesce("label", "k"))

    rank = F.row_number().over(_window("cluster", "block", "label").orderBy(F.xxhash64("k")))
    envoys = labelled(components(edges)).withColumn("rank", rank).filter(F.col("rank") <= ENVOYS).withColumn("ask", F.lit(True))
    envoys = _dealt(stored(envoys.drop("rank")), "block", block_shingles, 1)
    edges = stored(edges.union(_verified(envoys, percent)))
    now = stored(labelled(components(edges)))
    counts = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("largest"))
    # outsiders go in packs, and each pair of a pack and a block is a group of its own
    outside = _dealt(stored(now.join(largest, "cluster").filter("label <> largest").drop("largest")), "pack", block_shingles, 2)
    outside = stored(outside)
    packs = outside.groupBy("cluster").agg(F.max("pack").alias("last"))
    home = now.join(small(stored(packs)), "cluster").withColumn("ask", F.lit(False)).withColumn(
        "pack", F.explode(F.sequence(F.lit(0), F.col("last"))))
    away = outside.withColumn("ask", F.lit(True)).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    away = away.filter("to <> block").withColumn("block", F.col("to"))
    cols = ["cluster", "pack", "block", "k", "label", "ask", "shingles"]
    pairs = home.select(*cols).unionByName(away.select(*cols)).withColumn(  # one number for (pack, block)
        "block", F.col("pack").cast("long") * (1 << 31) + F.col("block"))
    edges = edges.union(_verified(pairs, percent, visitors=True))
    return components(stored(edges))


def _window(*cols: str):
    from pyspark.sql import Window
    return Window.partitionBy(*cols)


# ---------------------------------------------------------------- the operator

def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT, universe: float = UNIVERSE, block_shingles: int = BLOCK_SHINGLES,
                       with_hash: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_shingles (size of its set), component_id (smallest id that links reach).

    Words stand between ASCII white space, A-Z lower-cased. A text of fewer than ``words``
    words has one shingle, itself. Null and empty texts have none, link with nothing and
    are their own component. Null ids never are the smallest; a component of null ids only
    has a null id. Repeated rows each come out. Other columns are ignored. With
    ``with_hash`` a column text_hash (xxhash64 of the text) tells rows of one id apart.
    """
    text = F.col(text_col).cast("string")
    wide = docs.select(text.alias("_text"), F.col(id_col).alias("_id"))
    kind = wide.schema["_id"].dataType.simpleString()
    named = docs.select(text.alias("_text"), F.struct(F.col(id_col).alias("i"), F.xxhash64(text).alias("h")).alias("_id"))
    rows = stored(named.mapInArrow(lambda it: tidied(_describe(words, False, it)), f"_id struct<i:{kind},h:bigint>, n long, hi long, lo long")
                  .select(F.col("_id.i").alias("_id"), F.col("_id.h").alias("text_hash"), "n", "hi", "lo"))
    classes = stored(rows.filter("n > 0").groupBy("hi", "lo").agg(
        F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    source = _text_source(words)
    near = stored(prefixes(wide, source, percent, universe).select("hi", "lo"))
    # the texts of the sets that stay, one of each class
    reps = small(near.join(classes, ["hi", "lo"]).select(F.col("least").alias("_least")).distinct())
    texts = wide.join(reps, F.col("_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = texts.mapInArrow(lambda it: tidied(_describe(words, True, it)), f"_id {kind}, n long, hi long, lo long, shingles binary")
    sets = sets.join(small(near), ["hi", "lo"], "left_semi").dropDuplicates(["hi", "lo"]).drop("_id")
    sets = stored(sets.withColumn("k", F.monotonically_increasing_id()))  # written once, so the numbers stay
    full = prefixes(sets.select("k", "shingles"), _set_source, percent, 1.0)
    buckets = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    lists = full.select("hi", "n", "tokens", "places").mapInArrow(lambda it: tidied(_lists_out(buckets, it)), _Packs.schema)
    edges = lists.repartitionById(buckets, "bucket").mapInArrow(lambda it: tidied(_candidates(percent, it)), "a long, b long")
    clusters = components(edges)
    found = linked(sets.select("k", "n", "shingles"), clusters, percent, block_shingles)
    named = sets.select("k", "hi", "lo").join(found.withColumnRenamed("a", "k"), "k").join(classes, ["hi", "lo"])
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    changed = named.join(least, "root").select("hi", "lo", "component")
    # only classes of several rows, or linked ones, look their component up
    known = classes.join(changed, ["hi", "lo"], "left").filter("copies > 1 or component is not null").select(
        "hi", "lo", F.coalesce("component", "least").alias("component"), F.lit(True).alias("_known"))
    out = rows.join(known, ["hi", "lo"], "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(
        (F.col("n") > 0) & F.col("_known"), F.col("component")).otherwise(F.col("_id")).alias("component_id"),
        *(["text_hash"] if with_hash else []))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
