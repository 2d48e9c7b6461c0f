"""Quality rules with distribution divergence.

Base rules count words, symbols, repeated lines and repeated word windows. The method's own
verdict compares two histograms of a document with language references by Jensen-Shannon
distance: its character classes, and how often it uses each common word. The references are
learned from all documents: a document counts for the language whose common words it uses
most, and its bytes and words are added to that language's histograms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tandem.llm.frames import free_name, others, quoted, text_bytes
from tandem.llm.text import BLANKS, byte_arrays, slices, word_bounds, word_hashes

# Common words by language.
COMMON = {
    "en": "the of and to in a is it that for was on are with as be by this at from or an not have which".split(),
    "de": "der die das und ist in zu den von mit sich des auf für nicht im dem ein eine als auch es an".split(),
    "fr": "le la les de des et un une en est que du dans pour qui pas au sur avec par ce il plus".split(),
    "es": "el la los las de y que en un una es por con para del se no su al lo como más o".split(),
}
SYMBOLS = b"#*$%&|<>"
# Classes: lower case, upper case, digit, blank, line end, full stop or comma, other mark, symbol, not ASCII.
CLASSES = 9

MIN_WORDS = 20          # fewer: failed by the base rules
MIN_CHARS = 200         # below, the character classes say too little to judge
MIN_COMMON_WORDS = 100  # below, the common words say too little to judge
CLASS_DISTANCE = 0.38   # farther from every language: not kept
COMMON_DISTANCE = 0.385

_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_CLASS[[44, 46]] = 5
_CLASS[list(SYMBOLS)] = 7
_CLASS[128:] = 8

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words in `width`-windows that occur twice or more; exact, by ranking windows of 1, 2, 4, 8 words."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    rank, size = np.unique(ids, return_inverse=True)[1], 1
    while size < width:
        pair = rank[:-size] * len(ids) + rank[size:]
        rank, size = np.unique(pair, return_inverse=True)[1], size * 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += again
    edge[width:width + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> int:
    """`repeated_words` of one document; equal hashes are confirmed on the words themselves."""
    if len(hashes) < 9:
        return 0
    # A window found twice holds words found twice: hashes decide cheaply that there is none.
    ids = np.unique(hashes, return_inverse=True)[1]
    if ids.max() + 8 >= len(ids) and len(ids) - ids.max() - 1 < 8:
        return 0
    found = repeated_words(ids)
    if found:
        raw, known = data.tobytes(), {}
        ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
        found = repeated_words(ids)
    return found


def _dup_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\v\f\r")]
    return len(lines) - len(set(lines))


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(row * CLASSES + _CLASS[data], minlength=CLASSES * (len(offsets) - 1)).reshape(-1, CLASSES)


class _Common:
    """Looks up words by hash in the common words of every language."""

    def __init__(self, common: dict[str, Sequence[str]]):
        self.languages = list(common)
        words = sorted({w for listed in common.values() for w in listed})
        joined = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in words])
        hashes = word_hashes(joined, np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.keys, self.size = hashes[order], len(words)
        self.number = order
        place = {w: i for i, w in enumerate(words)}
        self.columns = [np.array([place[w] for w in common[lang]]) for lang in self.languages]

    def counts(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Occurrences of each common word, by row."""
        at = np.minimum(np.searchsorted(self.keys, hashes), self.size - 1)
        hit = self.keys[at] == hashes
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))[hit]
        return np.bincount(row * self.size + self.number[at[hit]], minlength=self.size * (len(first) - 1)).reshape(-1, self.size)

    def histograms(self, counts: np.ndarray, n_words: np.ndarray) -> list[np.ndarray]:
        """By language: the counts of its words, and of all other words."""
        result = []
        for columns in self.columns:
            own = counts[:, columns]
            result.append(np.column_stack([own, n_words - own.sum(1)]))
        return result


def _bare(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case and marks as blanks, so that `The,` is the word `the`."""
    kind = _CLASS[data]
    data = np.where(kind == 1, data + np.uint8(32), data)
    return np.where((kind >= 5) & (kind <= 7), np.uint8(32), data)


def language_references(docs: DataFrame, text: str = "text", common: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per language with documents: `language`, `classes` and `words` (counts over all of them).

    A document of no common word counts for no language; null and empty texts count for none.
    """
    common = common or COMMON
    look = _Common(common)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.zeros((len(look.languages), CLASSES), np.int64)
        words = [np.zeros(len(c) + 1, np.int64) for c in look.columns]
        for batch in slices(batches):
            data, offsets = byte_arrays(batch.column("text"))
            bare = _bare(data)
            starts, ends, first = word_bounds(bare, offsets)
            counts = look.counts(word_hashes(bare, starts, ends), first)
            by_language = look.histograms(counts, np.diff(first))
            used = np.column_stack([h[:, :-1].sum(1) for h in by_language])
            best = np.where(used.max(1) > 0, used.argmax(1), -1)
            kinds = _class_counts(data, offsets)
            for i, histogram in enumerate(by_language):
                classes[i] += kinds[best == i].sum(0)
                words[i] += histogram[best == i].sum(0)
        rows = [(lang, part, i, int(n)) for lang, c, w in zip(look.languages, classes, words)
                for part, values in (("classes", c), ("words", w)) for i, n in enumerate(values) if n]
        if rows:
            columns = list(zip(*rows))
            yield pa.record_batch([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32()),
                                   pa.array(columns[3], pa.int64())], ["language", "part", "bin", "n"])

    cells = docs.select(text_bytes(text).alias("text")).mapInArrow(tally, "language string, part string, bin int, n long")
    return cells.groupBy("language", "part", "bin").agg(F.sum("n").alias("n"))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts `p` from counts `q`; 1 where either is empty."""
    if not q.sum():
        return np.ones(len(p))
    total = p.sum(1, keepdims=True)
    a, b = p / np.maximum(total, 1), q / q.sum()
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        right = np.where(b > 0, b * np.log2(b / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def quality_rules(
    docs: DataFrame, text: str = "text", common: dict[str, Sequence[str]] | None = None,
    min_chars: int = MIN_CHARS, min_common_words: int = MIN_COMMON_WORDS,
    class_distance: float = CLASS_DISTANCE, common_distance: float = COMMON_DISTANCE,
) -> DataFrame:
    """`docs` plus the base counts, `base_failed`, both distances and `kept`, as one struct `rules` (replaced if there).

    Distances are to the nearest language. A document with fewer than `min_chars` bytes (or
    `min_common_words` words) is not judged by that histogram. Null and empty texts have no
    words and so fail the base rules. The references hold a few hundred numbers, whatever the
    input; they are the only thing that comes to the driver. Where no document has a common
    word there is no reference, and the base rules alone decide.
    """
    common = common or COMMON
    look = _Common(common)
    classes = np.zeros((len(look.languages), CLASSES))
    words = [np.zeros(len(c) + 1) for c in look.columns]
    for row in language_references(docs, text, common).collect():
        i = look.languages.index(row["language"])
        (classes[i] if row["part"] == "classes" else words[i])[row["bin"]] = row["n"]
    known = [i for i in range(len(look.languages)) if classes[i].sum()]
    before, held = others(docs, "rules"), free_name(docs, "__bytes")
    names = [*before, "rules"]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, held):
            data, offsets = byte_arrays(batch.column(held))
            starts, ends, first = word_bounds(data, offsets)
            hashes = word_hashes(data, starts, ends)
            n = len(offsets) - 1
            n_words = np.diff(first)
            char = (data & 0xC0) != 0x80
            word_chars = _per_row(char & ~BLANKS[data], offsets)
            kinds = _class_counts(data, offsets)
            repeats, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(n):
                a, b = first[i], first[i + 1]
                own = slice(a, b)
                repeats[i] = _repeats(data, starts[own], ends[own], hashes[own])
                lines[i] = _dup_lines(data[offsets[i]:offsets[i + 1]].tobytes())
            failed = (n_words < MIN_WORDS) | (100 * repeats > 30 * n_words)
            bare = _bare(data)
            s, e, f = word_bounds(bare, offsets)
            used = look.histograms(look.counts(word_hashes(bare, s, e), f), np.diff(f))
            by_class = np.min([js_distance(kinds, classes[i]) for i in known], 0) if known else np.zeros(n)
            by_word = np.min([js_distance(used[i], words[i]) for i in known], 0) if known else np.zeros(n)
            strange = (np.diff(offsets) >= min_chars) & (by_class > class_distance)
            strange |= (np.diff(f) >= min_common_words) & (by_word > common_distance)
            columns = [n_words, word_chars, kinds[:, 7], lines, repeats]
            struct = pa.StructArray.from_arrays(
                [*(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed), pa.array(by_class.astype(float)),
                 pa.array(by_word.astype(float)), pa.array(~failed & ~strange)],
                [*(c.split()[0] for c in COUNTS.split(", ")), "base_failed", "class_distance", "common_distance", "kept"])
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, struct], names)

    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in COUNTS.split(", "))
    rules = f"struct<{fields}, base_failed: boolean, class_distance: double, common_distance: double, kept: boolean>"
    schema = StructType([*(docs.schema[c] for c in before), *StructType.fromDDL(f"rules {rules}").fields])
    return docs.select(*map(quoted, before), text_bytes(text).alias(held)).mapInArrow(judge, schema)
