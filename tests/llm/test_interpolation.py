"""Interpolated bigrams against plain dictionaries."""

import math
import re
from collections import Counter
from random import Random
from zlib import crc32

import numpy as np
import pytest

from tandem.llm import interpolation as lm, packing


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def part(i):
    crc = crc32(("" if i is None else str(i)).encode())
    return lm.SCORED if crc % 5 == 1 else lm.HELD_BACK if crc // 5 % lm.DELETED == 0 else lm.TRAINED


class Plain:
    def __init__(self, texts):
        self.one, self.two, self.documents = Counter(), Counter(), 0
        for text in texts:
            w = tokens(text)
            self.one.update(w)
            self.two.update(zip(["<begin>", *w], w))
            self.documents += 1
        self.n, self.kinds = sum(self.one.values()), len(self.one)

    def estimates(self, before, word):
        seen = self.documents if before == "<begin>" else self.one[before]
        return (seen.bit_length(), self.two[before, word] / seen if seen else 0.0,
                self.one[word] / self.n if self.n else 0.0, 1 / (self.kinds + 1))

    def log10(self, text, weights):
        w = tokens(text)
        total = 0.0
        for before, word in zip(["<begin>", *w], w):
            bucket, *p = self.estimates(before, word)
            total += math.log10(sum(float(a) * b for a, b in zip(weights[bucket], p)))
        return total

    def base(self, text):
        return sum(math.log10((self.one[w] + 0.5) / (self.n + 0.5 * (self.kinds + 1))) for w in tokens(text))


def plain_weights(held, rest):
    """Expectation maximisation on every token by itself."""
    events = [rest.estimates(b, w) for text in held for t in [tokens(text)] for b, w in zip(["<begin>", *t], t)]

    def climb(events, towards, now):
        for _ in range(lm.ROUNDS):
            sums = [lm.PRIOR * t for t in towards]
            for _, *p in events:
                shares = [a * b for a, b in zip(now, p)]
                sums = [s + x / sum(shares) for s, x in zip(sums, shares)]
            now = [s / sum(sums) for s in sums]
        return now

    every = climb(events, [1 / 3] * 3, [1 / 3] * 3)
    return every, {b: climb([e for e in events if e[0] == b], every, [1 / 3] * 3) for b in {e[0] for e in events}}


def corpus(n=260, seed=1):
    rng = Random(seed)
    words = [f"w{i}" for i in range(60)]
    follow = {w: rng.sample(words, 4) for w in words}
    rows = []
    for i in range(n):
        text, w = [], rng.choice(words[:10])
        for _ in range(rng.randint(0, 40)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow.get(w, words)) if rng.random() < 0.8 else rng.choice(words) if rng.random() < 0.9 else f"new{rng.randrange(10 ** 6)}"
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "É é E e"), (None, "w1 w2"), (None, None), (5, "w1 " * 3000), (5, rows[5][1])]
    return rows + [(2000 + i, "the very same text") for i in range(40)]


def kept_weights(docs, **settings):
    chunks = lm.chunks_of(docs, "doc_id", "text", lm.parts_of("doc_id"), settings.get("chunk_bytes", lm.CHUNK_BYTES))
    answers, totals = lm.counted(chunks, settings.get("range_tokens", lm.RANGE_TOKENS))
    return lm.learn(chunks, answers, totals), totals


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 400, "range_tokens": 150}])
def test_scores(spark, settings):
    """Also in many chunks and ranges of hashes."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weights, totals = kept_weights(docs, **settings)
    model = Plain(t for i, t in rows if part(i) != lm.SCORED)
    rest = Plain(t for i, t in rows if part(i) == lm.TRAINED)
    assert (totals.tokens, totals.kinds, totals.documents) == (model.n, model.kinds, model.documents)
    assert (totals.rest_tokens, totals.rest_kinds, totals.rest_documents) == (rest.n, rest.kinds, rest.documents)
    every, by_bucket = plain_weights([t for i, t in rows if part(i) == lm.HELD_BACK], rest)
    for bucket, want in by_bucket.items():
        if bucket:
            assert np.abs(weights[bucket] - want).max() < 0.03
    assert len(by_bucket) > 4 and np.allclose(weights.sum(1), 1) and weights[0, 0] == 0
    got = Counter()
    for r in lm.with_scores(docs, **settings).collect():
        got[(r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))] += 1
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        want[(i, part(i) == lm.SCORED, len(w), sum(model.one[x] > 0 for x in w), model.n,
              round(model.base(t), 6), round(model.log10(t, weights), 6))] += 1
    assert got == want


def test_probabilities_sum_to_one(spark):
    rows = corpus(80, 2)
    weights, _ = kept_weights(spark.createDataFrame(rows, "doc_id long, text string"))
    model = Plain(t for i, t in rows if part(i) != lm.SCORED)
    for before in ["<begin>", "w1", "w2", "w59", "never seen"]:
        total = sum(10 ** math.log10(sum(float(a) * b for a, b in zip(weights[e[0]], e[1:])))
                    for e in (model.estimates(before, w) for w in [*model.one, "unknown"]))
        assert abs(total - 1) < 1e-9


def test_it_explains_unseen_texts_better(spark):
    rows = [r for r in corpus(400, 3) if r[0] != 5]
    scored = [r for r in lm.with_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert len(scored) > 40 and sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored) + 0.2 * sum(r["n_tokens"] for r in scored)


@pytest.mark.parametrize("rows", [[(1, "a b")], [(3, None)], [(i, "a b a") for i in (1, 2, 3, 4)], [(None, "x")]])
def test_tiny_tables(spark, rows):
    for r in lm.with_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        model = Plain(t for i, t in rows if part(i) != lm.SCORED)
        assert abs(r["base_score"] - model.base(dict(rows)[r["id"]])) < 1e-9 and r["train_tokens"] == model.n
        assert -100 < r["score"] <= 0


def test_empty_and_clashing(spark):
    assert lm.with_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = ["chunk", "id", "part", "words", "word", "place", "score", "tokens", "ids"]
    rows = corpus(20)
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    plain = lm.with_scores(spark.createDataFrame(rows, "doc_id long, text string"))
    near = lambda df: sorted((str(r["id"]), r["n_tokens"], round(r["score"], 6)) for r in df.collect())
    assert near(lm.with_scores(docs)) == near(plain)


def test_packing():
    rng = np.random.default_rng(4)
    for n in (0, 1, 700):
        values = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        assert (packing.unpacked(packing.packed(values), np.uint64) == values).all()
        assert (packing.risen(packing.rising(np.sort(values))) == np.sort(values)).all()
