"""Toxicity by a weighted finite-state pattern grammar.

Words are classed by a lexicon (insult, threat, target, negation, reported speech, other);
each clause is a string of classes. Small transducers rewrite it one after the other: reported
speech and negation weaken what stands in their scope, a target near an insult or threat
strengthens it. They are composed into one machine that runs once over every clause holding
an insult or a threat; path weight times lexical weight is the clause's strength. Insults are
learned from labelled documents as words and word stems; clause strengths become a probability
by logistic regression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tandem.llm.frames import free_name, others, quoted, text_bytes
from tandem.llm.labelled import training_sample
from tandem.llm.text import byte_arrays, lowered, slices, word_bounds, word_hashes

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oitynr"
WEAK_INSULT, WEAK_THREAT, AIMED_INSULT, AIMED_THREAT = "juab"

# Grammar words by class, for the four languages of the corpus.
WORDS = {
    THREAT: "kill hurt beat destroy punch shoot stab burn hang töten schlagen vernichten tuer frapper matar golpear".split(),
    TARGET: "you your yours he him she they them du dich dir ihr sie tu te toi vous ils tú ti usted ellos".split(),
    NEGATION: "not never no isn aren don doesn nobody nicht kein keine nie niemals pas jamais aucun nunca jamás ni".split(),
    REPORT: "said says wrote quoted called claimed reported sagte schrieb zitiert dit écrit cité dijo escribió citó".split(),
}
# Insults known before any label is seen.
INSULTS = (
    "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb fool "
    "imbecile jerk trottel abschaum dummkopf crétin imbécile ordure estúpido imbécil basura"
).split()
PATH_WEIGHTS = {INSULT: 1.0, AIMED_INSULT: 1.3, WEAK_INSULT: 0.6, THREAT: 0.2, AIMED_THREAT: 0.8, WEAK_THREAT: 0.1}

TRAIN_ROWS = 6_000
STEM_BYTES = range(4, 9)
MIN_SHARE = 0.02   # of toxic documents that a learned entry occurs in
MIN_ODDS = 3.0     # least log odds ratio of a learned entry
ENTRIES = 400


@dataclass
class Transducer:
    """Deterministic: arcs map (state, symbol) to (state, symbol, weight). A missing arc copies the
    symbol with weight 0 and goes to the state's default."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    default: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.default.get(state, state), symbol, 0.0)


def scoped(opens: str, changes: dict[str, str], reach: int | None) -> Transducer:
    """After `opens`, symbols are changed for `reach` words (None: to the end of the clause)."""
    states = range(1, 2) if reach is None else range(1, reach + 1)
    last = 1 if reach is None else reach
    arcs = {(s, opens): (last, opens, 0.0) for s in (0, *states)}
    after = {s: s if reach is None else s - 1 for s in states}
    arcs |= {(s, a): (after[s], b, 0.0) for s in states for a, b in changes.items()}
    return Transducer(arcs, after)


def weigher(weights: dict[str, float]) -> Transducer:
    return Transducer({(0, symbol): (0, symbol, w) for symbol, w in weights.items()})


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The machine that feeds the output of `first` into `second`; weights add up."""
    arcs, number, todo = {}, {(0, 0): 0}, [(0, 0)]
    while todo:
        pair = todo.pop()
        for symbol in alphabet:
            a, middle, w = first.step(pair[0], symbol)
            b, out, v = second.step(pair[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], symbol] = (number[a, b], out, w + v)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Reported speech, then negation, then target, then weights."""
    machine = scoped(REPORT, {INSULT: WEAK_INSULT, THREAT: WEAK_THREAT}, None)
    for part in (
        scoped(NEGATION, {INSULT: WEAK_INSULT, THREAT: WEAK_THREAT}, 3),
        scoped(TARGET, {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}, 4),
        weigher(PATH_WEIGHTS),
    ):
        machine = compose(machine, part, OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT)
    return machine


def clause_strength(machine: Transducer, symbols: str, lexical: Iterable[float]) -> float:
    """Sum over the clause of path weight times lexical weight."""
    state, total = 0, 0.0
    for symbol, weight in zip(symbols, lexical):
        state, _, path = machine.arcs[state, symbol]
        total += path * weight
    return total


_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;:\n")] = True


def _words(data: np.ndarray, offsets: np.ndarray):
    bare = lowered(np.where(_MARKS[data], np.uint8(32), data))
    return bare, *word_bounds(bare, offsets)


def _stem_hashes(bare: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of each word's first `size` bytes, 0 for words not longer than that."""
    longer = ends - starts > size
    result = np.zeros(len(starts), np.uint64)
    result[longer] = word_hashes(bare, starts[longer], starts[longer] + size) ^ np.uint64(size)
    return result


def _hashes_of(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return word_hashes(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


@dataclass
class Model:
    """Lexicon as hashes with class and weight, stem lengths in use, and the logistic weights."""

    keys: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    stems: list[int]
    logistic: np.ndarray
    machine: Transducer

    def strengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By row: sum and maximum of clause strengths."""
        result = np.zeros((len(offsets) - 1, 2))
        bare, starts, ends, first = _words(data, offsets)
        if not len(starts):
            return result
        place = np.full(len(starts), -1)
        known = np.zeros(1 << 16, bool)
        known[self.keys & np.uint64(0xFFFF)] = True
        for hashes in (word_hashes(bare, starts, ends), *(_stem_hashes(bare, starts, ends, s) for s in self.stems)):
            maybe = np.flatnonzero(known[hashes & np.uint64(0xFFFF)] & (place < 0))
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[maybe]
            place[maybe[hit]] = at[hit]
        found = np.flatnonzero(place >= 0)
        strong = found[np.isin(self.classes[place[found]], [INSULT, THREAT])]
        if not len(strong):
            return result
        closes = np.concatenate([[0], np.cumsum(_ENDS[data])])
        clause = closes[starts]  # sentence marks before the word, so one number per clause
        symbols = np.full(len(starts), OTHER)
        symbols[found] = self.classes[place[found]]
        lexical = np.where(place >= 0, self.weights[place], 0.0)
        row = np.searchsorted(first, strong, "right") - 1
        for r, c in sorted(set(zip(row.tolist(), clause[strong].tolist()))):
            a = max(first[r], np.searchsorted(clause, c, "left"))
            b = min(first[r + 1], np.searchsorted(clause, c, "right"))
            value = clause_strength(self.machine, "".join(symbols[a:b]), lexical[a:b].tolist())
            result[r, 0] += value
            result[r, 1] = max(result[r, 1], value)
        return result

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(self.strengths(data, offsets)) @ self.logistic, -30, 30)))


def _features(strengths: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(strengths)), np.log1p(strengths)])


def _joined(sample: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in sample], dtype=np.int64)])
    return np.frombuffer(b"".join(t for t, _ in sample), np.uint8), offsets


def learn_insults(sample: list[tuple[bytes, int]], entries: int = ENTRIES) -> dict[int, dict[int, float]]:
    """Log odds by entry hash, by stem length (0: whole words), of what toxic documents say more often."""
    toxic = [s for s in sample if s[1]]
    clean = [s for s in sample if not s[1]]
    if not toxic or not clean:
        return {}
    least = max(4, MIN_SHARE * len(toxic))
    found = []
    for size in (0, *STEM_BYTES):
        def documents(group: list[tuple[bytes, int]], only: np.ndarray | None) -> Counter:
            seen = Counter()
            for i in range(0, len(group), 200):
                data, offsets = _joined(group[i:i + 200])
                bare, starts, ends, first = _words(data, offsets)
                h = _stem_hashes(bare, starts, ends, size) if size else word_hashes(bare, starts, ends)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                if only is not None:
                    wanted = np.isin(h, only)
                    h, row = h[wanted], row[wanted]
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                values, counts = np.unique(h[new], return_counts=True)
                seen.update(dict(zip(values.tolist(), counts.tolist())))
            return seen

        often = {h: n for h, n in documents(toxic, None).items() if n >= least and h}
        if not often:
            continue
        other = documents(clean, np.array(sorted(often), np.uint64))
        for h, n in often.items():
            odds = np.log((n + 0.5) / (len(toxic) + 1)) - np.log((other[h] + 0.5) / (len(clean) + 1))
            if odds >= MIN_ODDS:
                found.append((n, odds, size, h))
    chosen: dict[int, dict[int, float]] = {}
    for _, odds, size, h in sorted(found, reverse=True)[:entries]:
        chosen.setdefault(size, {})[h] = float(odds)
    return chosen


def train(sample: list[tuple[bytes, int]]) -> Model:
    """Lexicon, then logistic weights by Newton steps. Without toxic or without clean examples the
    lexicon holds the fixed words only."""
    entries: dict[int, tuple[str, float]] = {}
    stems = []
    for size, learned in sorted(learn_insults(sample).items()):
        stems += [size] if size else []
        entries |= {h: (INSULT, w) for h, w in learned.items()}
    for symbol, words in {INSULT: INSULTS, **WORDS}.items():
        entries |= {int(h): (symbol, 4.0) for h in _hashes_of(words) if int(h) not in entries}
    keys = np.array(sorted(entries), np.uint64)
    model = Model(keys, np.array([entries[int(h)][0] for h in keys]), np.array([entries[int(h)][1] for h in keys]),
                  stems, np.array([-2.0, 1.0, 1.0]), grammar())
    if sample:
        y = np.array([label for _, label in sample], float)
        x = np.vstack([_features(model.strengths(*_joined(sample[i:i + 200]))) for i in range(0, len(sample), 200)])
        weights, hold = np.zeros(3), np.diag([1e-2, 1e-1, 1e-1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (p - y) + hold @ weights
            weights = weights - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, slope)
        model.logistic = weights
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    return train(training_sample(docs, labels, "toxic", rows, key, text))


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` plus the probability of being toxic as `name`, which replaces a column of that name.

    Null and empty texts have no clause and get the base rate.
    """

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, held):
            found = model.probabilities(*byte_arrays(batch.column(held)))
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names)

    before, held = others(docs, name), free_name(docs, "__bytes")
    names = [*before, name]
    schema = StructType([*(docs.schema[c] for c in before), StructField(name, DoubleType())])
    return docs.select(*map(quoted, before), text_bytes(text).alias(held)).mapInArrow(score, schema)
