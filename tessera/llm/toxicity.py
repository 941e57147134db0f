"""Toxicity: class-conditional Kneser-Ney models with shared backoff counts.

Two models, toxic and ordinary, of words after the word before them. A word on its own is a
chain of two expressions: its first ``PREFIX`` bytes, then the whole word. n_c counts the labelled texts of class c that have a
word (of a prefix: pairs of text and word), so a word counts once in a text. An absolute
discount ``D`` is taken from every count, and what it takes goes to a backoff that both
classes share:

    p_c(e | h) = (max(n_c(e) - D, 0) + L_c(h) * q(e | h)) / n_c(h)
    L_c(h)     = sum over e' after h of min(n_c(e'), D)

so each p_c adds up to 1. The backoff q is made of the shared counts of both classes: for
prefixes (h: the start of a word) Kneser-Ney's continuation counts, the number of different
words that a prefix goes on to, as a share of all words; for words after a prefix their
share of its pairs. Where a class has not seen h, p_c is q. An expression that no class has
more than ``D`` times has the same factor q in both, which cancels out; all rare expressions
of a prefix share one ratio.

A word w after a word v backs off to the chain of w. n_c(v, w) counts the texts where w stands
next to v, n_c(v) adds them up over all w, and the discount is the same:

    p_c(w | v) = (max(n_c(v, w) - D, 0) + L_c(v) * p_c(w)) / n_c(v)

or p_c(w) where the class has not seen v, and for a text's first word. Pairs that no class has
more than ``D`` times share one factor, L_c(v) / n_c(v), so n_c(v) is counted by history and
only the other pairs are kept.

A text is scored by log-likelihood ratios per word, log p_toxic - log p_ordinary after the
word before it, less that of an unknown word: normalised by length over the whole text, over its
windows (the best of 3 and of 20 words), and over its strongest words (the best 1 to 16). A
toxic text of hundreds of words differs from others in a few of them only, which the mean
of the whole text can't show alone. The score is a logistic function of these means, fitted
on texts put aside, with counts of the others; the counts that score are those of all
labelled texts, the ones put aside included.

Counts are kept per expression (a hash of 64 bits) and grow with the vocabulary: a task adds
its texts up, packs of sorted hashes (their differences compressed) go to buckets, and a bucket
is added up in parts. What
has a ratio of its own is a table, sent to the tasks. Beyond ``BROADCAST_ROWS`` rows it is sent
in groups by ranges of hashes; a task then looks the words of many texts up in one group after
the other and holds one at a time, so no word of a document is ever written or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BROADCAST_ROWS, id_remainder, read, small, stored
from tessera.llm.kernels import ALNUM_WORDS, mix, stream, tidied, word_chunks

PREFIX, D = 5, 3.0
PREFIXES = (PREFIX,)
LINKS = 2
#: Least texts of an expression that is more than discounted.
LEAST = int(D) + 1
#: Labelled texts (by a hash of their content) that fit the logistic function, at most so many.
CALIBRATION_SHARE, CALIBRATION_ROWS = 0.2, 50_000
#: Expressions of a task that are held before they are passed on; a bucket is added up in 2 ** PART_BITS parts.
FLUSH, PART_BITS = 1 << 19, 3
#: Strongest words and window lengths whose means score a text; the last feature adds up what is clearly toxic.
TOPS, WINDOWS, CLEAR = (1, 2, 3, 5, 8, 16), (3, 20), 1.0
FEATURES = len(TOPS) + len(WINDOWS) + 2
RIDGE = 1.0
#: Words that a task holds to look them up in one group after the other; least rows of a group.
GROUP_WORDS, GROUP_ROWS = 1 << 21, 100

_U = np.uint64
#: Set in the parents of pairs, clear in those of words.
_PAIR = _U(1)
#: Highest bits of a hash by which most that are not in a table are told.
_MAYBE_BITS = 24
_PACK = "bucket int, part int, n int, m int, hashes binary, heads binary, parents binary, counts binary"
_TABLE = "hash long, parent long, word long, c0 long, c1 long, c2 long, c3 long, types long"
_COLUMNS = [x.split()[0] for x in _TABLE.split(", ")]


def _expressions(h: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Hashes (prefix, word) of each word; a word that is its own prefix has two different ones."""
    out = mix(np.vstack([parts, h[None, :]]) ^ stream(LINKS, 31)[:, None])
    out[0] &= ~_PAIR
    return out


def _histories(h: np.ndarray) -> np.ndarray:
    """Hashes of words as what stands before others."""
    return mix(h ^ stream(LINKS + 1, 31)[-1]) | _PAIR


def _pairs(histories: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of words after a history; the same turns a pair's hash into its word's."""
    return words ^ mix(histories)


def _inner(counts: np.ndarray) -> np.ndarray:
    """Places of the words that are not the first of their text."""
    inner = np.ones(int(counts.sum()), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    return np.flatnonzero(inner)


def _squeezed(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(a.reshape(len(a), -1).view(np.uint8).T), codec="zstd", asbytes=True)


def _unsqueezed(data: pa.Scalar, n: int, kind: type, width: int = 1) -> np.ndarray:
    size = width * np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=n * size, codec="zstd"), np.uint8)
    out = np.ascontiguousarray(planes.reshape(size, n).T).view(kind)
    return out if width > 1 else out.ravel()


def _headed(hashes: np.ndarray, parents: np.ndarray) -> tuple[int, bytes, bytes]:
    """The number of different parents, these, and the place of each hash's parent among them from 1; 0 is the hash itself."""
    other = hashes != parents
    heads, at = np.unique(parents[other], return_inverse=True)
    place = np.zeros(len(hashes), np.uint32)
    place[other] = at + 1
    return len(heads), _squeezed(np.diff(heads, prepend=_U(0))) if len(heads) else b"", _squeezed(place)


def _parents(hashes: np.ndarray, m: int, heads: pa.Scalar, places: pa.Scalar) -> np.ndarray:
    if not m:
        return hashes
    heads = np.append(_U(0), np.cumsum(_unsqueezed(heads, m, np.uint64), dtype=np.uint64))
    place = _unsqueezed(places, len(hashes), np.uint32)
    return np.where(place > 0, heads[place], hashes)


def _distinct(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each text's different words, and their texts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, owner))
    keep = np.ones(len(order), bool)
    keep[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return order[keep], owner[order[keep]]


def _pairs_of(h: np.ndarray, parts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories, hashes and texts of each text's different pairs of adjoining words."""
    at = _inner(counts)
    history = _histories(h[at - 1])
    pair = _pairs(history, _expressions(h[at], parts[:, at])[1])
    owner = np.repeat(np.arange(len(counts)), counts)[at]
    _, first = np.unique(pair ^ mix(owner.astype(np.uint64)), return_index=True)
    return history[first], pair[first], owner[first]


def _added(hashes: np.ndarray, parents: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes in order, their parents and the sums of their counts."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], first, axis=0, dtype=counts.dtype) if len(first) else counts
    return hashes[first], parents[order][first], sums


def _count(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of expressions, their parents and counts by 2 * aside + label, from rows (text, label, aside)."""
    held: list[tuple] = []
    waiting, limit = 0, FLUSH

    def packs(hashes: np.ndarray, parents: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        # the highest bits of a hash give its part, the next ones its bucket
        part = (hashes >> _U(64 - PART_BITS)).astype(np.int64)
        bucket = ((hashes << _U(PART_BITS)) >> _U(32)).astype(np.int64) * buckets >> 32
        place = part * buckets + bucket
        ends = np.flatnonzero(np.append(place[1:] != place[:-1], True)) + 1
        starts = np.append(0, ends[:-1])
        m, heads, places = zip(*(_headed(hashes[i:j], parents[i:j]) for i, j in zip(starts, ends)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts], pa.int32()), pa.array(part[starts], pa.int32()), pa.array(ends - starts, pa.int32()), pa.array(m, pa.int32()),
             pa.array([_squeezed(np.diff(hashes[i:j], prepend=_U(0))) for i, j in zip(starts, ends)], pa.binary()),
             pa.array(heads, pa.binary()), pa.array(places, pa.binary()),
             pa.array([_squeezed(counts[i:j]) for i, j in zip(starts, ends)], pa.binary())],
            [x.split()[0] for x in _PACK.split(", ")])

    for batch in batches:
        label, aside = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)).astype(np.int64) for i in (1, 2))
        kind = 2 * aside + label
        for lo, hi, h, counts, parts in word_chunks(batch.column(0), ALNUM_WORDS, PREFIXES):
            at, owner = _distinct(h, counts)
            prefix, word = _expressions(h[at], parts[:, at])
            history, pair, whose = _pairs_of(h, parts, counts)
            one, other = (np.zeros((len(x), 4), np.uint32) for x in (owner, whose))
            for x, texts in ((one, owner), (other, whose)):
                x[np.arange(len(texts)), kind[lo:hi][texts]] = 1
            # a prefix is its own parent, and so is a history
            held.append(_added(np.concatenate([prefix, word, history, pair]), np.concatenate([prefix, prefix, history, history]),
                               np.concatenate([one, one, other, other])))
            waiting += len(held[-1][0])
            if waiting > limit:
                held = [_added(*(np.concatenate(x) for x in zip(*held)))]
                waiting = len(held[0][0])
                if waiting > FLUSH:
                    yield from packs(*held[0])
                    held, waiting = [], 0
                limit = max(FLUSH, 2 * waiting)
    if waiting:
        yield from packs(*_added(*(np.concatenate(x) for x in zip(*held))))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and histories of at least ``LEAST`` texts, all prefixes, pairs of as many texts of one class, and for each
    prefix rows of how many different words it goes on to."""
    held: list[tuple] = []
    at = None

    def done() -> pa.RecordBatch:
        hashes, parents, counts = _added(*(np.concatenate(x) for x in zip(*held)))
        after, of_pairs = hashes != parents, (parents & _PAIR) > 0
        enough = np.maximum(counts[:, 0] + counts[:, 2], counts[:, 1] + counts[:, 3]) >= LEAST
        keep = np.where(of_pairs & after, enough, (counts.sum(axis=1) >= LEAST) | ~(after | of_pairs))
        of, types = np.unique(parents[after & ~of_pairs], return_counts=True)
        none = np.zeros(len(of), np.int64)
        words = np.where(of_pairs & after, _pairs(parents, hashes), _U(0))
        columns = [np.concatenate([hashes[keep], of]).view(np.int64), np.concatenate([parents[keep], of]).view(np.int64),
                   np.concatenate([words[keep].view(np.int64), none]),
                   *(np.concatenate([counts[keep, i], none]) for i in range(4)), np.concatenate([np.zeros(keep.sum(), np.int64), types])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)

    for batch in batches:
        bucket, part, size, size_heads, *arrays = (batch.column(i) for i in range(8))
        for i in range(batch.num_rows):
            place = bucket[i].as_py(), part[i].as_py()
            if held and place != at:
                yield done()
                held = []
            at = place
            n = size[i].as_py()
            hashes = np.cumsum(_unsqueezed(arrays[0][i], n, np.uint64), dtype=np.uint64)
            held.append((hashes, _parents(hashes, size_heads[i].as_py(), arrays[1][i], arrays[2][i]),
                         _unsqueezed(arrays[3][i], n, np.uint32, 4).astype(np.int64)))
            if len(held) == 32:
                held = [_added(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        yield done()


def counted(rows: DataFrame) -> DataFrame:
    """(hash, parent, word, c0 to c3, types), written, for rows (_text, _label, _aside): counts by 2 * aside + label.

    Words of fewer than ``LEAST`` texts are left out of the table, but not of what their
    prefix counts. Prefixes are their own parents; ``types`` are their different words. So
    are histories, whose pairs (``word``: the word's hash) are left out if no class has as many texts.
    """
    buckets = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    packs = rows.mapInArrow(lambda it: tidied(_count(buckets, it)), _PACK)
    packs = packs.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "part")
    merged = packs.mapInArrow(lambda it: tidied(_merge(it)), _TABLE)
    return stored(merged.groupBy("hash", "parent", "word").agg(*[F.sum(c).alias(c) for c in _COLUMNS[3:]]))


def ratios(table: DataFrame, classes: tuple[str, str], d: float = D) -> DataFrame:
    """(hash, seen, rest) of the expressions with a ratio of their own; ``classes`` sum the counts of ordinary and toxic texts.

    ``seen`` is the log ratio of the expression after what is before it. A prefix also has
    ``rest``, that of a word after it that is not in the table (0 for a prefix that is not
    either). A pair's ``seen`` is the whole ratio of its word after its history; a history's
    ``rest`` is what it adds to the words of other pairs. All are less the ratio of an unknown prefix.
    """
    n = table.select("hash", "parent", "word", "types", *[F.expr(c).cast("double").alias(f"n{i}") for i, c in enumerate(classes)])
    over = [F.greatest(F.col(f"n{i}") - d, F.lit(0.0)) for i in range(2)]
    prefixes, words = n.where("hash = parent and (parent & 1) = 0"), n.where("hash != parent and (parent & 1) = 0")
    histories, pairs = n.where("hash = parent and (parent & 1) = 1"), n.where("hash != parent and (parent & 1) = 1")
    top = prefixes.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(2)], *[F.sum(over[i]).alias(f"o{i}") for i in range(2)],
                       F.sum("types").alias("types")).first()
    size = [top["n0"] or 0.0, top["n1"] or 0.0]
    types = float(top["types"] or 1)
    free = [size[i] - (top[f"o{i}"] or 0.0) for i in range(2)]

    def share(i: int, count, left, whole, q):
        """p_i, where ``whole`` is what the class has seen before the expression."""
        return F.when(whole > 0, (count + left * q) / whole).otherwise(q)

    q = F.col("types") / F.lit(types)
    p = [share(i, over[i], F.lit(free[i]), F.lit(size[i]), q) for i in range(2)]
    unknown = np.log([free[i] / size[i] if size[i] and free[i] else 1.0 for i in range(2)])
    shift = float(unknown[1] - unknown[0])
    kept = words.groupBy("parent").agg(*[F.sum(over[i]).alias(f"k{i}") for i in range(2)])
    heads = (prefixes.select(F.col("hash").alias("head"), "types", "n0", "n1").join(kept.withColumnRenamed("parent", "head"), "head", "left")
             .fillna({"k0": 0.0, "k1": 0.0}))
    left = [F.when(F.col(f"n{i}") > 0, (F.col(f"n{i}") - F.col(f"k{i}")) / F.col(f"n{i}")).otherwise(1.0) for i in range(2)]
    # a class whose words after a prefix all stand above the discount still has D of each left
    rest = F.log(left[1]) - F.log(left[0])
    first = heads.select(F.col("head").alias("hash"), (F.log(p[1]) - F.log(p[0]) - F.lit(shift)).alias("seen"), rest.alias("rest"),
                         (F.greatest("n0", "n1") > d).alias("own"))
    first = first.where("own or rest != 0").drop("own")
    before = heads.select("head", *[F.col(c).alias(f"h_{c}") for c in ("n0", "n1", "k0", "k1")], *[p[i].alias(f"h_p{i}") for i in range(2)])
    after = words.where("n0 + n1 > 0").join(before, F.col("parent") == F.col("head"))
    q = (F.col("n0") + F.col("n1")) / (F.col("h_n0") + F.col("h_n1"))
    w = [share(i, over[i], F.col(f"h_n{i}") - F.col(f"h_k{i}"), F.col(f"h_n{i}"), q) for i in range(2)]
    second = after.where(F.greatest("n0", "n1") > d).select("hash", (F.log(w[1]) - F.log(w[0])).alias("seen"), F.lit(None).cast("double").alias("rest"))
    pairs = pairs.where(F.greatest("n0", "n1") > d).select("hash", "parent", "word", "n0", "n1", *[over[i].alias(f"o{i}") for i in range(2)])
    kept = pairs.groupBy("parent").agg(*[F.sum(f"o{i}").alias(f"k{i}") for i in range(2)])
    # a history whose pairs are all discounted away gives its words the ratio of their chains
    heads = histories.select("parent", *[F.col(f"n{i}").alias(f"h_n{i}") for i in range(2)]).join(kept, "parent")
    left = [F.when(F.col(f"h_n{i}") > 0, (F.col(f"h_n{i}") - F.col(f"k{i}")) / F.col(f"h_n{i}")).otherwise(1.0) for i in range(2)]
    third = heads.select(F.col("parent").alias("hash"), F.lit(None).cast("double").alias("seen"), (F.log(left[1]) - F.log(left[0])).alias("rest"))
    alone = after.select(F.col("hash").alias("word"), *[(F.col(f"h_p{i}") * w[i]).alias(f"p{i}") for i in range(2)])
    pairs = pairs.join(heads, "parent").join(alone, "word")
    v = [share(i, F.col(f"o{i}"), F.col(f"h_n{i}") - F.col(f"k{i}"), F.col(f"h_n{i}"), F.col(f"p{i}")) for i in range(2)]
    fourth = pairs.select("hash", (F.log(v[1]) - F.log(v[0]) - F.lit(shift)).alias("seen"), F.lit(None).cast("double").alias("rest"))
    return first.unionByName(second).unionByName(third.where("rest != 0")).unionByName(fourth)


class KneserNey:
    """Ratios by expression, as sorted arrays."""

    def __init__(self, hashes: np.ndarray, seen: np.ndarray, rest: np.ndarray) -> None:
        hashes = hashes.astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.seen, self.rest = hashes[order], np.nan_to_num(seen[order]), np.nan_to_num(rest[order])
        self._maybe = None

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def _found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those of ``hashes`` that are in the table, and where they are there; most are not."""
        if self._maybe is None:  # made by each worker that needs it
            self._maybe = np.zeros(1 << _MAYBE_BITS, bool)
            self._maybe[self.hashes >> _U(64 - _MAYBE_BITS)] = True
        some = np.flatnonzero(self._maybe[hashes >> _U(64 - _MAYBE_BITS)])
        at, known = self._at(hashes[some])
        return some[known], at[known]

    def ratios(self, h: np.ndarray, parts: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """log p_toxic - log p_ordinary of each word, less that of an unknown one.

        With ``counts`` (words a text, one after the other) after the word before it, else of the word alone.
        """
        prefix, word = _expressions(h, parts)
        (p, known), (w, own) = self._at(prefix), self._at(word)
        if not len(self.hashes):
            return np.zeros(len(h))
        out = np.where(known, self.seen[p], 0.0) + np.where(own, self.seen[w], np.where(known, self.rest[p], 0.0))
        if counts is not None:
            inner = _inner(counts)
            history = _histories(h[inner - 1])
            some, at = self._found(history)
            out[inner[some]] += self.rest[at]
            some, at = self._found(_pairs(history, word[inner]))
            out[inner[some]] = self.seen[at]
        return out


def features(ratio: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of the ratios of each text's words (``counts`` words a text, one after the other); no words give zeros."""
    n = len(counts)
    out = np.zeros((n, FEATURES))
    ends = np.cumsum(counts)
    starts = ends - counts
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    owner = np.repeat(np.arange(n), counts)
    order = np.lexsort((-ratio, owner))
    sums = np.concatenate([[0.0], np.cumsum(ratio[order])])
    for i, k in enumerate(TOPS):
        m = np.minimum(counts, k)
        out[:, i] = (sums[starts + m] - sums[starts]) / np.maximum(m, 1)
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    mean = (sums[ends] - sums[starts]) / np.maximum(counts, 1)
    for i, k in enumerate(WINDOWS, len(TOPS)):
        out[:, i] = mean
        long = np.flatnonzero(counts >= k)
        if len(long):
            begin = np.repeat(starts[long] - np.concatenate([[0], np.cumsum(counts[long] - k + 1)[:-1]]), counts[long] - k + 1)
            begin = begin + np.arange(len(begin))
            first = np.concatenate([[0], np.cumsum(counts[long] - k + 1)[:-1]])
            out[long, i] = np.maximum.reduceat((sums[begin + k] - sums[begin]) / k, first)
    out[:, -2] = mean
    clear = np.concatenate([[0.0], np.cumsum(np.maximum(ratio - CLEAR, 0.0))])
    out[:, -1] = 10 * (clear[ends] - clear[starts]) / np.maximum(counts, 1)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _feature_rows(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns, then the features of the text (the first column)."""
    kn = model.value
    for batch in batches:
        out = np.zeros((batch.num_rows, FEATURES))
        for lo, hi, h, counts, parts in word_chunks(batch.column(0), ALNUM_WORDS, PREFIXES):
            out[lo:hi] = features(kn.ratios(h, parts, counts), counts)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], _lists(out)], [*batch.schema.names[1:], "_f"])


def _group(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The group of each hash: ranges of hashes of equal width."""
    return ((hashes >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)


def _places(hashes: np.ndarray, groups: int) -> list[np.ndarray]:
    """The places of ``hashes`` by group."""
    group = _group(hashes, groups)
    return np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=groups))[:-1])


def _ratios_by_group(models: list, h: np.ndarray, parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``KneserNey.ratios`` of each word after the word before it, with one group of the table at a time."""
    prefix, word = _expressions(h, parts)
    inner = _inner(counts)
    history = _histories(h[inner - 1])
    pair = _pairs(history, word[inner])
    first, left, own = np.zeros(len(h)), np.zeros(len(h)), np.full(len(h), np.nan)
    more, whole = np.zeros(len(inner)), np.full(len(inner), np.nan)
    places = [_places(x, len(models)) for x in (prefix, word, history, pair)]
    for model, of_prefix, of_word, of_history, of_pair in zip(models, *places):
        kn = model.value
        at, known = kn._at(prefix[of_prefix])
        first[of_prefix[known]], left[of_prefix[known]] = kn.seen[at[known]], kn.rest[at[known]]
        at, known = kn._at(word[of_word])
        own[of_word[known]] = kn.seen[at[known]]
        some, at = kn._found(history[of_history])
        more[of_history[some]] = kn.rest[at]
        some, at = kn._found(pair[of_pair])
        whole[of_pair[some]] = kn.seen[at]
        if getattr(model, "_path", None):  # where it is read from again
            vars(model).pop("_value", None)
    out = first + np.where(np.isnan(own), left, own)
    out[inner] = np.where(np.isnan(whole), out[inner] + more, whole)
    return out


def _feature_rows_by_group(models: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_feature_rows`` with a table in groups: about ``GROUP_WORDS`` words are looked up together."""
    held: list[tuple] = []
    waiting: list[tuple[pa.RecordBatch, np.ndarray]] = []
    words = 0

    def score() -> None:
        if held:
            counts = np.concatenate([x[4] for x in held])
            ratio = _ratios_by_group(models, np.concatenate([x[3] for x in held]), np.concatenate([x[5] for x in held], axis=1), counts)
            at = 0
            for out, lo, hi, h, n, _ in held:
                out[lo:hi] = features(ratio[at : at + len(h)], n)
                at += len(h)
            held.clear()

    def rows() -> Iterator[pa.RecordBatch]:
        for batch, out in waiting:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _lists(out)], [*batch.schema.names[1:], "_f"])
        waiting.clear()

    for batch in batches:
        out = np.zeros((batch.num_rows, FEATURES))
        for lo, hi, h, counts, parts in word_chunks(batch.column(0), ALNUM_WORDS, PREFIXES):
            held.append((out, lo, hi, h, counts, parts))
            words += len(h)
            if words >= GROUP_WORDS:
                score()
                yield from rows()  # the batches before this one
                words = 0
        waiting.append((batch, out))
    score()
    yield from rows()


class _Shared:
    """The table of a model, sent to the tasks: as one, or in groups if it is large. The driver holds one group at a time."""

    def __init__(self, table: DataFrame, max_rows: int) -> None:
        table = stored(table)
        self.table = table
        n = table.count()
        groups = 1 if n <= max_rows else -(-n // max(max_rows, GROUP_ROWS))
        of = F.shiftright(F.shiftrightunsigned("hash", 32) * groups, 32)
        self.groups = [self._send(table.where(of == g) if groups > 1 else table) for g in range(groups)]
        self.sent = self.groups[0] if groups == 1 else None

    @staticmethod
    def _send(table: DataFrame):
        got = table.toArrow()
        model = KneserNey(*(got[c].to_numpy() for c in ("hash", "seen", "rest")))
        del got
        sent = table.sparkSession.sparkContext.broadcast(model)
        del model
        pa.default_memory_pool().release_unused()
        return sent

    def drop(self) -> None:
        """Frees what was sent, also in the driver; rows must have been scored."""
        for sent in self.groups:
            sent.destroy()

    def features(self, wide: DataFrame) -> DataFrame:
        """All columns but the text (the first), then _f."""
        kind = wide.drop("_text").schema.add("_f", T.ArrayType(T.DoubleType()))
        model, models = self.sent, self.groups
        if model is not None:
            return wide.mapInArrow(lambda it: tidied(_feature_rows(model, it)), kind)
        return wide.mapInArrow(lambda it: tidied(_feature_rows_by_group(models, it)), kind)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> np.ndarray:
    """Intercept and weights of logistic regression with a ridge on standardised features, by Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.append(0.0, np.ones(x.shape[1]))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread)


class ToxicityModel:
    """Fitted models; ``score`` adds ``score`` and ``predicted``."""

    def __init__(self, shared: _Shared, weights: np.ndarray) -> None:
        self.shared, self.weights = shared, weights

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns of ``docs`` but the text, then score double (0 to 1) and predicted int.

        Null and empty texts have no words and get the score of ratios of 0; very long
        texts are read whole; repeated rows have one score. Extra columns pass through;
        own columns named score or predicted are replaced.
        """
        rest = [c for c in docs.columns if c != text_col and c not in ("score", "predicted", "_f")]
        wide = docs.select(F.col(text_col).cast("string").alias("_text"), *rest)
        rows = self.shared.features(wide)
        line = F.lit(float(self.weights[0]))
        for i, w in enumerate(self.weights[1:]):
            line = line + F.col("_f")[i] * F.lit(float(w))
        return (rows.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-500.0)), F.lit(500.0)))))
                .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("_f"))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", max_rows: int = BROADCAST_ROWS) -> ToxicityModel:
    """Models from labelled texts (label 1: toxic). Null labels are left out; null texts are empty.

    Texts are put aside for the logistic function by a hash of their content, so copies
    never stand on both sides; its weights then go with the counts of all texts. Without
    two classes the score is the share of toxic rows. Above ``max_rows`` expressions with a
    ratio of their own, these are sent in groups.
    """
    rows = labelled.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
                           F.col(label_col).cast("int").alias("_label")).filter("_label in (0, 1)")
    aside = F.pmod(F.xxhash64("_text"), F.lit(1000)) < int(1000 * CALIBRATION_SHARE)
    table = counted(rows.withColumn("_aside", aside.cast("int")))
    shared = _Shared(ratios(table, ("c0", "c1")), max_rows)
    held = shared.features(rows.filter(aside)).orderBy(F.xxhash64("_f"), "_f", "_label").limit(CALIBRATION_ROWS).toPandas()
    shared.drop()  # the driver would hold it as long as that of all texts
    y = held["_label"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        weights = _logistic(np.stack(held["_f"]), y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.25
        weights = np.append(np.log(share / (1 - share)), np.zeros(FEATURES))
    return ToxicityModel(_Shared(ratios(table, ("c0 + c2", "c1 + c3")), max_rows), weights)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """Texts with a label; a document labelled more than once counts as toxic if any row says so."""
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias(label_col))
    return docs.select("doc_id", "text").join(small(one), "doc_id")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    train = labelled_texts(docs.filter(id_remainder("doc_id", 5) != 0), labels)
    model = fit(train)
    return model.score(docs).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

