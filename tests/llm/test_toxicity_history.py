"""Words after the word before them: the models by their definition, and texts that differ in the order of words only."""

import random

import numpy as np
import pyarrow as pa
from test_toxicity import SCHEMA, _plain

from tessera.llm import toxicity
from tessera.llm.kernels import ALNUM_WORDS, word_chunks


def _ratios(model, text):
    (_, _, h, counts, parts), = word_chunks(pa.array([text]), ALNUM_WORDS, toxicity.PREFIXES)
    return model.shared.sent.value.ratios(h, parts, counts)


def test_words_after_a_word_equal_their_definition_and_add_up(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i)}{'x' * (i % 3)}" for i in range(14)]
    texts = []
    for i in range(400):
        words = rng.choices(vocabulary, [(1 + j % 4) ** 2 for j in range(14)], k=9)
        if rng.random() < 0.6:
            words[3:5] = [vocabulary[3], vocabulary[7]] if i % 2 else [vocabulary[7], vocabulary[3]]
        texts.append((" ".join([*words, f"once{i}"]), i % 2))
    words, p, shift = _plain(texts)
    pairs = [{}, {}]
    for text, label in texts:
        w = text.split()
        for pair in set(zip(w, w[1:])):
            pairs[label][pair] = pairs[label].get(pair, 0) + 1
    d = toxicity.D

    def after(c, v, w):
        mine = {b: n for (a, b), n in pairs[c].items() if a == v}
        if not mine:
            return p(c, w)
        return (max(mine.get(w, 0) - d, 0) + sum(min(n, d) for n in mine.values()) * p(c, w)) / sum(mine.values())

    for v in vocabulary:
        for c in (0, 1):
            assert abs(sum(after(c, v, w) for w in words) - 1) < 1e-9
    model = toxicity.fit(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], SCHEMA))
    for v in [*vocabulary, "once3"]:
        for w in [*vocabulary, "once1"]:
            assert abs(_ratios(model, f"{v} {w}")[1] - (np.log(after(1, v, w) / after(0, v, w)) - shift)) < 1e-9, (v, w)


def test_the_order_of_words_alone_tells_texts_apart(spark):
    rng = random.Random(6)
    words = [f"plain{i}" for i in range(60)]
    rows = []
    for i in range(600):
        text = rng.choices(words, k=12)
        text[5:7] = ["you", "rot"] if i % 2 else ["rot", "you"]
        rows.append((i, " ".join(text), i % 2))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs)
    assert _ratios(model, "you rot")[1] > 1 > -1 > _ratios(model, "rot you")[1]
    assert model.score(docs).where("predicted = toxic").count() == 600


def test_packs_come_back_whole():
    rng = np.random.default_rng(2)
    for a, kind, width in ((rng.integers(0, 1 << 63, 1000).astype(np.uint64), np.uint64, 1),
                           (rng.integers(0, 9, (77, 4)).astype(np.uint32), np.uint32, 4), (np.zeros(1, np.uint64), np.uint64, 1)):
        back = toxicity._unsqueezed(pa.scalar(toxicity._squeezed(a), pa.binary()), len(a), kind, width)
        assert back.shape == a.shape and (back == a).all()
