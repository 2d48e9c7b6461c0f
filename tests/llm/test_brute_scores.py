"""Toxicity, quality and quality rules against plain versions, one word, window or byte at a time."""

import math
import random
import re
from collections import Counter

import numpy as np

from tandem.llm import quality_cnn, quality_rules, toxicity


# -- toxicity: the transducers one after the other -------------------------------------

def classed(model, word):
    """Class and weight of a word: itself first, then its stems."""
    keys = {int(k): (c, float(w)) for k, c, w in zip(model.keys, model.classes, model.weights)}
    found = keys.get(int(toxicity._hashes_of([word])[0]))
    for size in model.stems:
        raw = word.encode()
        if found is None and len(raw) > size:
            stem = np.frombuffer(raw[:size], np.uint8)
            found = keys.get(int(toxicity.word_hashes(stem, np.array([0]), np.array([size]))[0]) ^ size)
    return found or ("o", 0.0)


def rewritten(symbols, opens, changes, reach):
    """After `opens` symbols are changed, for `reach` words or to the end; another opening begins anew."""
    out, left = [], 0
    for s in symbols:
        if s == opens:
            left = reach if reach else math.inf
            out.append(s)
            continue
        out.append(changes.get(s, s) if left > 0 else s)
        left -= left > 0
    return out


def plain_strengths(model, text):
    clauses, total, most = re.split(r"[.!?;:\n]", text), 0.0, 0.0
    for clause in clauses:
        bare = "".join(" " if re.match(r"[!-/:-@\[-`{-~]", c) else c.lower() if "A" <= c <= "Z" else c for c in clause)
        words = [classed(model, w) for w in re.split(r"[\x20\x09-\x0D]+", bare) if w]
        symbols = [c for c, _ in words]
        symbols = rewritten(symbols, "r", {"i": "j", "t": "u"}, None)
        symbols = rewritten(symbols, "n", {"i": "j", "t": "u"}, 3)
        symbols = rewritten(symbols, "y", {"i": "a", "t": "b"}, 4)
        value = sum(toxicity.PATH_WEIGHTS.get(s, 0.0) * w for s, (_, w) in zip(symbols, words))
        total, most = total + value, max(most, value)
    return total, most


def plain_probability(model, text):
    x = [1.0, *(math.log1p(s) for s in plain_strengths(model, text or ""))]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.logistic))))))


def clauses(n, seed):
    rng = random.Random(seed)
    pool = ["idiot", "IDIOT", "losers", "kill", "hurt", "you", "They", "not", "never", "said", "wrote", "zorgish", "zorgable", "plain", "house",
            "été", "töten", "niemals", "x", "isn't", "the"]
    return ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "\n", "; ", " (", "\t"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_toxicity_is_the_transducers_one_after_the_other(spark, mixed_rows):
    sample = [(t.encode(), int("zorg" in t)) for t in clauses(400, 1)]
    model = toxicity.train(sample)
    assert model.stems  # stems were learned, too
    texts = clauses(300, 2) + [t for _, t in mixed_rows if t and len(t) < 5000]
    data = [t.encode() for t in texts]
    got = model.strengths(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    want = [plain_strengths(model, t) for t in texts]
    assert np.allclose(got, want, atol=1e-9) and sum(s > 0 for s, _ in want) > 100
    rows = [(i, t) for i, t in enumerate([*texts[:60], None, ""])]
    scored = toxicity.with_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert all(abs(r["score"] - plain_probability(model, r["text"])) < 1e-9 for r in scored)


# -- quality: every window of every chunk by itself ------------------------------------

def plain_quality(net, raw):
    tops = []
    for k in range(1 + max(0, -(-(len(raw) - 512) // 448))):
        chunk = list(raw[448 * k:448 * k + 512])
        chunk += [256] * (512 - len(chunk))
        best = [0.0] * net.filters.shape[1]
        for at in range(0, 505, 4):
            x = np.concatenate([net.embed[b].astype(float) for b in chunk[at:at + 8]])
            for f in range(len(best)):
                best[f] = max(best[f], float(x @ net.filters[:, f].astype(float)) + float(net.bias[f]))
        tops.append(best)
    doc = [sum(c) / len(c) for c in zip(*tops)] + [max(c) for c in zip(*tops)]
    hidden = [max(0.0, float(np.dot(doc, net.dense[:, h].astype(float))) + float(net.dense_bias[h])) for h in range(net.dense.shape[1])]
    return 1 / (1 + math.exp(-(float(np.dot(hidden, net.out.astype(float))) + float(net.out_bias[0]))))


def test_quality_is_the_network_window_by_window():
    rng = random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 8, 200, 511, 512, 513, 960, 961, 1500)]
    for net in (quality_cnn.new_network(), quality_cnn.train([(t * 3, i % 2) for i, t in enumerate(texts)], steps=15)):
        data = np.frombuffer(b"".join(texts), np.uint8)
        got = quality_cnn.probabilities(net, data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        assert np.allclose(got, [plain_quality(net, t) for t in texts], atol=1e-4)


def test_gradients_are_those_of_the_loss():
    """Against differences of the loss, in doubles, for some weights of every kind."""
    rng = np.random.default_rng(5)
    net = quality_cnn.new_network()
    for name, value in vars(net).items():
        setattr(net, name, value.astype(np.float64) + rng.normal(0, 0.05, value.shape))
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (30, 700, 1400, 0)]
    y = np.array([1.0, 0.0, 1.0, 0.0])
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, first = quality_cnn.chunks_of(data, offsets)
    symbols = quality_cnn._symbols(data, starts, np.repeat(offsets[1:], np.diff(first)))

    def loss():
        top, _ = quality_cnn.pooled(net, symbols)
        hidden = np.maximum(quality_cnn._documents(top, first) @ net.dense + net.dense_bias, 0)
        p = quality_cnn._sigmoid(hidden @ net.out + net.out_bias[0])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    used = [int(s) for s in np.unique(symbols)]
    for (name, weights), gradient in zip(vars(net).items(), quality_cnn._gradients(net, symbols, first, y)):
        assert gradient.shape == weights.shape
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in weights.shape)
            at = (used[at[0] % len(used)], *at[1:]) if name == "embed" else at
            old, eps = weights[at], 1e-5
            weights[at] = old + eps
            up = loss()
            weights[at] = old - eps
            down = loss()
            weights[at] = old
            assert abs((up - down) / (2 * eps) - gradient[at]) < 1e-4 + 1e-3 * abs(gradient[at]), (name, at)


# -- quality rules: distances and verdict ----------------------------------------------

def byte_class(b):
    if b >= 128:
        return 8
    c = chr(b)
    return (0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 4 if c == "\n" else 3 if c in " \t\v\f\r"
            else 5 if c in ",." else 7 if c in "#*$%&|<>" else 6)


def histograms(text):
    raw = text.encode()
    kinds = [0] * 9
    for b in raw:
        kinds[byte_class(b)] += 1
    bare = bytes(32 if byte_class(b) in (5, 6, 7) else b + 32 if byte_class(b) == 1 else b for b in raw)
    words = [w.decode(errors="replace") for w in re.split(rb"[\x20\x09-\x0D]+", bare) if w]
    counts = Counter(words)
    used = {lang: [counts[w] for w in listed] for lang, listed in quality_rules.COMMON.items()}
    return kinds, {lang: [*own, len(words) - sum(own)] for lang, own in used.items()}, len(words), len(raw)


def js(p, q):
    a, b = sum(p), sum(q)
    if not a or not b:
        return 1.0
    total = 0.0
    for x, y in zip(p, q):
        x, y = x / a, y / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return math.sqrt(min(1.0, max(0.0, total)))


def test_quality_rules_judge_by_both_distances(spark, mixed_rows):
    rng = random.Random(6)
    rows = list(mixed_rows)
    for i in range(160):
        lang, share = rng.choice(list(quality_rules.COMMON)), rng.choice([0, 0.7, 0.9])
        words = [rng.choice(quality_rules.COMMON[lang]) if rng.random() < share else "".join(rng.choice("abcdeio") for _ in range(6)) for _ in range(rng.randint(5, 220))]
        noise = rng.choice([0, 0, 0, 0.3, 0.8])
        rows.append((5000 + i, " ".join(w.upper() if rng.random() < noise / 2 else "^{~7}%" if rng.random() < noise else w for w in words) + rng.choice([".", "\n", " #"])))
    texts = [t or "" for _, t in rows]
    made = [histograms(t) for t in texts]
    languages = list(quality_rules.COMMON)
    classes, common = {lang: [0] * 9 for lang in languages}, {lang: [0] * (len(quality_rules.COMMON[lang]) + 1) for lang in languages}
    for kinds, used, _, _ in made:
        score = [sum(used[lang][:-1]) for lang in languages]
        if max(score):
            own = languages[score.index(max(score))]
            classes[own] = [a + b for a, b in zip(classes[own], kinds)]
            common[own] = [a + b for a, b in zip(common[own], used[own])]
    known = [lang for lang in languages if sum(classes[lang])]
    assert len(known) == 4
    judged = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_row = Counter((r["doc_id"], r["text"], round(r["rules"]["class_distance"], 6), round(r["rules"]["common_distance"], 6), r["rules"]["kept"]) for r in judged)
    failed = {(r["doc_id"], r["text"]): r["rules"]["base_failed"] for r in judged}
    want, verdicts = Counter(), Counter()
    for (i, t), (kinds, used, n_words, n_bytes) in zip(rows, made):
        by_class = min(js(kinds, classes[lang]) for lang in known)
        by_word = min(js(used[lang], common[lang]) for lang in known)
        strange = n_bytes >= quality_rules.MIN_CHARS and by_class > quality_rules.CLASS_DISTANCE
        rare = n_words >= quality_rules.MIN_COMMON_WORDS and by_word > quality_rules.COMMON_DISTANCE
        kept = not failed[i, t] and not strange and not rare
        verdicts[failed[i, t], strange, rare, kept] += 1
        want[i, t, round(by_class, 6), round(by_word, 6), kept] += 1
    assert by_row == want, verdicts
    assert any(k[1] and not k[0] for k in verdicts) and any(k[2] and not k[0] for k in verdicts) and any(k[3] for k in verdicts)
