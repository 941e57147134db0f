"""Counts of the toxicity models: every expression on its own, all labelled texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.kernels import ALNUM_WORDS, word_chunks

SCHEMA = "doc_id long, text string, toxic int"


def _ratio(model, word):
    (_, _, h, _, parts), = word_chunks(pa.array([word]), ALNUM_WORDS, toxicity.PREFIXES)
    return float(model.shared.sent.value.ratios(h, parts)[0])


def _labelled(texts, spark):
    """Texts with whether they are put aside for the logistic function."""
    rows = spark.createDataFrame(texts, SCHEMA)
    return rows.withColumn("aside", F.pmod(F.xxhash64("text"), F.lit(1000)) < 1000 * toxicity.CALIBRATION_SHARE)


def test_rare_toxic_words_keep_their_counts_in_a_large_vocabulary(spark):
    """12 toxic texts pass the discount by little; 400,000 other words must not share their counts."""
    rng = random.Random(1)
    filler = [f"{i:06x}{rng.randrange(1 << 16):04x}" for i in rng.sample(range(1 << 24), 400_000)]
    rare = [f"zz{chr(97 + i)}qvenom" for i in range(20)]
    texts = [filler[200 * i : 200 * i + 200] for i in range(2000)]
    for j, word in enumerate(rare):
        for i in range(12):
            texts[2 * (12 * j + i) + 1].append(word)
    rows = spark.createDataFrame([(i, " ".join(t), i % 2) for i, t in enumerate(texts)], SCHEMA)
    model = toxicity.fit(rows)
    words = {w[:5] for t in texts for w in t}
    assert len(rare) * toxicity.LINKS <= model.shared.table.count() <= len(rare) + len(words)
    assert min(_ratio(model, w) for w in rare) > 2 and abs(_ratio(model, "unknownword")) < 1e-9


def test_texts_put_aside_are_counted_too(spark):
    rows = [(i, f"plain words of text number n{i} " + ("awful " if i % 2 else "") + ("venomous" if i % 2 else "harmless"), i % 2)
            for i in range(600)]
    extra, i = [], 0
    while len(extra) < 40:  # texts with a word that stands in put-aside texts only
        batch = _labelled([(10_000 + j, f"poisonous thing of number m{j}", 1) for j in range(i, i + 400)], spark)
        extra += [(r["doc_id"], r["text"], 1) for r in batch.collect() if r["aside"]]
        i += 400
    model = toxicity.fit(spark.createDataFrame(rows + extra[:40], SCHEMA))
    assert _ratio(model, "poisonous") > 2


def test_scores_by_a_join_equal_those_by_a_shared_table(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=30) + (["nasty", "foulest"] if i % 2 else ["gentle"])), i % 2) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None, 0), (900, "", 1), (901, rows[0][1], 0)], SCHEMA)
    a, b = (sorted(((str(r["doc_id"]), r["score"], r["predicted"]) for r in toxicity.fit(docs, max_rows=n).score(docs).collect()))
            for n in (10_000, 0))
    assert [x[0] for x in a] == [x[0] for x in b] and [x[2] for x in a] == [x[2] for x in b]
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-9)


def _plain(texts):
    """log p_1 - log p_0 of any word, less that of an unknown prefix, by the definition; and the models p(class, word)."""
    d, k = toxicity.D, toxicity.PREFIX
    n = [{}, {}]
    for text, label in texts:
        for w in set(text.split()):
            n[label][w] = n[label].get(w, 0) + 1
    words = sorted(set(n[0]) | set(n[1]))
    heads = {}
    for w in words:
        heads.setdefault(w.encode()[:k], []).append(w)

    def p(c, w):
        h = w.encode()[:k]
        count = lambda g: sum(n[c].get(x, 0) for x in heads.get(g, ()))
        size = sum(map(count, heads))
        left = sum(min(count(g), d) for g in heads)
        q = len(heads.get(h, ())) / len(words)
        first = (max(count(h) - d, 0) + left * q) / size
        if not heads.get(h):
            return None
        pooled = sum(n[i].get(w, 0) for i in (0, 1)) / sum(n[i].get(x, 0) for i in (0, 1) for x in heads[h])
        if not count(h):
            return first * pooled
        rest = sum(min(n[c].get(x, 0), d) for x in heads[h])
        return first * (max(n[c].get(w, 0) - d, 0) + rest * pooled) / count(h)

    left = [sum(min(sum(n[c].get(x, 0) for x in v), d) for v in heads.values()) / sum(n[c].values()) for c in (0, 1)]
    return words, p, np.log(left[1] / left[0])


def test_models_equal_their_definition_and_add_up(spark):
    rng = random.Random(9)
    stems = ["plain", "nasty", "xy", "kindly", "abcde"]
    vocabulary = [s + "".join(rng.choices("abc", k=rng.randint(0, 3))) for s in stems for _ in range(8)]
    texts = []
    for i in range(500):
        label = i % 2
        weights = [(3 if (w[0] == "n") == bool(label) else 1) * (1 + j % 5) ** 2 for j, w in enumerate(vocabulary)]
        texts.append((" ".join([*rng.choices(vocabulary, weights, k=12), f"once{i}x", f"nasty{i}"][: 14 - i % 2]), label))
    words, p, shift = _plain(texts)
    for c in (0, 1):
        assert abs(sum(p(c, w) for w in words) - 1) < 1e-9
    model = toxicity.fit(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], SCHEMA))
    for w in words:
        assert abs(_ratio(model, w) - (np.log(p(1, w) / p(0, w)) - shift)) < 1e-9, w
    assert _ratio(model, "neverseen") == 0


def test_means_of_words_windows_and_texts():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 30, 0, 100, 20])
    ratio = rng.normal(size=counts.sum())
    got = toxicity.features(ratio, counts)
    at = 0
    for row, n in zip(got, counts):
        v, at = ratio[at:at + n], at + n
        if not n:
            assert (row == 0).all()
            continue
        o = np.sort(v)[::-1]
        want = [o[:k].mean() for k in toxicity.TOPS]
        want += [max(v[i:i + k].mean() for i in range(n - k + 1)) if n >= k else v.mean() for k in toxicity.WINDOWS]
        want += [v.mean(), 10 * np.maximum(v - toxicity.CLEAR, 0).mean()]
        assert np.allclose(row, want)
