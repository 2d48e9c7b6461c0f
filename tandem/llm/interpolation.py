"""Language-model scores by deleted interpolation of bigrams.

The probability of a token is a mixture of maximum-likelihood estimates: of the token after the
one before it, of the token alone, and of any token alike. The mixture's weights depend on how
often the context was seen, in buckets of doubling counts, and are learned by expectation
maximisation: an eighth of the training documents is deleted from the counts, and the weights are those
under which the rest's counts explain the deleted tokens best. Then all training documents count.

Counts are exact and of the whole corpus; no task holds them all. Texts are cut into chunks that
keep their tokens as numbers; a chunk asks for the counts of its different words and bigrams,
one packed row for each range of hashes it needs. The task of a range adds up what all chunks
have and answers each in the order it asked, so that an answer is a list of counts. Chunks and their
answers meet again to be scored. A frequent word costs one entry a chunk, not one a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from tandem.llm.frames import discard, quoted, stored, text_bytes
from tandem.llm.packing import packed, range_starts, rising, risen, unpacked
from tandem.llm.text import byte_arrays, joined, lowered, mix, slices, word_bounds, word_hashes

CHUNK_BYTES = 8 << 20    # of text in one chunk (or one longer text)
RANGE_TOKENS = 1 << 20   # tokens in the corpus for each range of hashes
PER_TASK = 4             # chunks, or ranges of hashes, in one partition
DELETED = 8              # one training document in so many is deleted for learning the weights
STEPS = 8                # probabilities of deleted tokens are told apart to an eighth of a factor of two
PRIOR = 3.0              # tokens by which a bucket's weights are drawn to those of all buckets
ROUNDS = 200
BEGIN, END = (mix(np.array([n], np.uint64))[0] for n in (101, 102))
SCORED, TRAINED, HELD_BACK = 0, 1, 2

@dataclass
class Tokens:
    """A chunk's tokens: different words and bigrams by ascending hash, and where each token is among them."""

    words: np.ndarray
    word: np.ndarray       # by token
    context: np.ndarray    # by token: the word before it; the number of words for the beginning
    bigrams: np.ndarray
    bigram: np.ndarray     # by token
    first: np.ndarray      # first token of each document (every document ends with one)

    @classmethod
    def of(cls, words: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> "Tokens":
        first = np.cumsum(lengths) - lengths
        context = np.concatenate([[len(words)], word[:-1]])
        context[first] = len(words)
        bigrams, bigram = np.unique(joined(np.append(words, BEGIN)[context], words[word]), return_inverse=True)
        return cls(words, word, context, bigrams, bigram, first)


def chunks_of(docs: DataFrame, key: str, text: str, part: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a chunk, stored: chunk, held_back, tokens, ids, parts, lengths (tokens by document), words, word."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        held = {False: 0, True: 0}
        for batch in slices(batches, "text", chunk_bytes):
            back = batch.column("part").to_numpy() == HELD_BACK
            for side in (False, True):
                own = batch.filter(pa.array(back == side))
                if not own.num_rows:
                    continue
                size = int(byte_arrays(own.column("text"))[1][-1])
                if waiting[side] and held[side] + size > chunk_bytes:
                    yield chunk(side, waiting[side])
                    waiting[side], held[side] = [], 0
                waiting[side].append(own)
                held[side] += size
        for side, rows in waiting.items():
            if rows:
                yield chunk(side, rows)

    def chunk(side: bool, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        data, offsets = byte_arrays(whole.column("text"))
        data = lowered(data)
        starts, ends, first = word_bounds(data, offsets)
        hashes = np.insert(word_hashes(data, starts, ends), first[1:], END)
        words, word = np.unique(hashes, return_inverse=True)
        lengths = np.diff(first) + 1
        ends = pa.array([0, whole.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid4().bytes], pa.binary()), pa.array([side]), pa.array([len(hashes)], pa.int64()),
             pa.ListArray.from_arrays(ends, whole.column("id")), pa.ListArray.from_arrays(ends, whole.column("part")),
             pa.ListArray.from_arrays(ends, pa.array(lengths, pa.int64())),
             pa.array([rising(words)], pa.binary()), pa.array([packed(word.astype(np.uint32))], pa.binary())],
            ["chunk", "held_back", "tokens", "ids", "parts", "lengths", "words", "word"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(quoted(key)).alias("id"), text_bytes(text).alias("text"), part.cast("int").alias("part"))
    return stored(rows.mapInArrow(
        cut, f"chunk binary, held_back boolean, tokens long, ids array<{kind}>, parts array<int>, lengths array<long>, words binary, word binary"),
        "lm-chunks")


def _tokens(row: dict) -> tuple[Tokens, np.ndarray]:
    """A chunk's tokens, and by token whether it is trained on."""
    lengths = np.array(row["lengths"], np.int64)
    tokens = Tokens.of(risen(row["words"]), unpacked(row["word"], np.uint32).astype(np.int64), lengths)
    return tokens, np.repeat(np.array(row["parts"]) != SCORED, lengths)


@dataclass
class Totals:
    """Of all training documents, and of those that are not held back: tokens, different tokens, documents."""

    tokens: int
    kinds: int
    documents: int
    rest_tokens: int
    rest_kinds: int
    rest_documents: int


STATS = ("tokens", "kinds", "documents", "rest_tokens", "rest_kinds", "rest_documents")


def counted(chunks: DataFrame, range_tokens: int = RANGE_TOKENS) -> tuple[DataFrame, Totals]:
    """By chunk and range of hashes, the counts asked for (stored: chunk, held_back, place, words, bigrams), and totals."""
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(1, -(-tokens // range_tokens))
    bounds = range_starts(ranges)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own, trained = _tokens(row)
                columns: list[list] = []
                for hashes, at in ((own.words, own.word), (own.bigrams, own.bigram)):
                    n = np.bincount(at, trained, len(hashes)).astype(np.uint64)
                    cut = [*np.searchsorted(hashes, bounds).tolist(), len(hashes)]
                    columns.append([(rising(hashes[a:b]), packed(n[a:b])) if a < b else (None, None) for a, b in zip(cut, cut[1:])])
                asked = [(place, *w, *g) for place, (w, g) in enumerate(zip(*columns)) if w[0] or g[0]]
                kinds = (pa.int64(), *(pa.binary(),) * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(asked), pa.binary()), pa.array([row["held_back"]] * len(asked)),
                     *(pa.array([a[k] for a in asked], kind) for k, kind in enumerate(kinds))],
                    ["chunk", "held_back", "place", "words", "word_n", "bigrams", "bigram_n"])

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        back = np.array(table.column("held_back").to_pylist())
        answers, stats = [], [0] * len(STATS)
        for name in ("word", "bigram"):
            hashes = [risen(h) if h else np.zeros(0, np.uint64) for h in table.column(name + "s").to_pylist()]
            n = [unpacked(c, np.uint64) if c else np.zeros(0, np.uint64) for c in table.column(name + "_n").to_pylist()]
            sizes = [len(h) for h in hashes]
            kinds, at = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.concatenate(n)
            total = np.bincount(at, n, len(kinds)).astype(np.uint64)
            held = np.bincount(at, n * np.repeat(back, sizes), len(kinds)).astype(np.uint64)
            if name == "word":
                rest, end = total - held, kinds == END
                stats = [total.sum(), (total > 0).sum(), total[end].sum(), rest.sum(), (rest > 0).sum(), rest[end].sum()]
            ends = np.cumsum(sizes)
            # A chunk held back also needs the counts without all that is held back.
            answers.append([packed(np.concatenate([total[at[b - s:b]], (total - held)[at[b - s:b]]]) if other else total[at[b - s:b]])
                            for b, s, other in zip(ends.tolist(), sizes, back.tolist())])
        rows = table.num_rows
        return pa.table([
            table.column("chunk"), table.column("held_back"), table.column("place"),
            *(pa.array(a, pa.binary()) for a in answers),
            *(pa.array([int(s)] + [0] * (rows - 1), pa.int64()) for s in stats)],
            names=["chunk", "held_back", "place", "words", "bigrams", *STATS])

    asked = chunks.mapInArrow(
        ask, "chunk binary, held_back boolean, place long, words binary, word_n binary, bigrams binary, bigram_n binary")
    # So many partitions that one is a few ranges, whatever the session's setting for shuffles is.
    dealt = asked.repartition(-(-ranges // PER_TASK), "place")
    answered = stored(dealt.groupBy("place").applyInArrow(
        answer, "chunk binary, held_back boolean, place long, words binary, bigrams binary, " + ", ".join(f"{s} long" for s in STATS)),
        "lm-answers")
    totals = answered.agg(*(F.sum(s).alias(s) for s in STATS)).first()
    return answered.drop(*STATS), Totals(*((totals[s] or 0) for s in STATS))


def _answers(table: pa.Table, of_rest: bool) -> list[np.ndarray]:
    """Counts of a chunk's words and bigrams from its answers, in order."""
    rows = sorted(table.select(["place", "words", "bigrams"]).to_pylist(), key=lambda r: r["place"])
    result = []
    for name in ("words", "bigrams"):
        parts = [unpacked(r[name], np.uint64) for r in rows]
        if rows and table.column("held_back")[0].as_py():
            parts = [p[len(p) // 2:] if of_rest else p[:len(p) // 2] for p in parts]
        result.append(np.concatenate(parts).astype(np.float64))
    return result


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 more than the binary logarithm of the count."""
    return np.where(count > 0, np.frexp(count)[1], 0)


BUCKETS = 65


def estimates(own: Tokens, words: np.ndarray, bigrams: np.ndarray, tokens: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By token: bucket of its context, and its probability after it and alone."""
    before = np.append(words, documents)[own.context]
    after = np.divide(bigrams[own.bigram], before, out=np.zeros(len(own.word)), where=before > 0)
    return bucket_of(before), after, words[own.word] / max(tokens, 1)


def learned(cells: Iterable[tuple[int, int | None, int | None, int]], rest_kinds: int) -> np.ndarray:
    """Weights by bucket of the three estimates: after the context, alone, any token alike.

    `cells`: bucket, the two probabilities as steps of a logarithm (null for 0), number of tokens.
    Expectation maximisation for all buckets together, then for each, drawn to the former.
    """
    rows = list(cells)
    bucket = np.array([r[0] for r in rows], np.int64)
    p = np.array([[0.0 if q is None else 2.0 ** (q / STEPS) for q in r[1:3]] + [1 / (rest_kinds + 1)] for r in rows]).reshape(-1, 3)
    n = np.array([r[3] for r in rows], float)
    every = np.full((1, 3), 1 / 3)
    weights = np.repeat(every, BUCKETS, axis=0)

    def step(now: np.ndarray, of: np.ndarray, towards: np.ndarray) -> np.ndarray:
        share = now[of] * p
        share *= (n / share.sum(1))[:, None]
        held = np.column_stack([np.bincount(of, share[:, k], len(now)) for k in range(3)]) + PRIOR * towards
        return held / held.sum(1, keepdims=True)

    for _ in range(ROUNDS):
        every = step(every, np.zeros(len(rows), np.int64), np.full((1, 3), 1 / 3))
    for _ in range(ROUNDS):
        weights = step(weights, bucket, every)
    weights[0, 0] = 0.0  # nothing follows a context that was never seen
    return weights / weights.sum(1, keepdims=True)


def met(tables: list[DataFrame]) -> list[GroupedData]:
    """Tables grouped by chunk, the first of which has one row for each, a few chunks to a partition."""
    parts = -(-max(tables[0].count(), 1) // PER_TASK)
    return [t.repartition(parts, "chunk").groupBy("chunk") for t in tables]


def learn(chunks: DataFrame, answers: DataFrame, totals: Totals) -> np.ndarray:
    """Weights from the documents held back, under the counts of the others.

    What comes to the driver is bounded by the grid of buckets and steps, not by the corpus.
    """

    def tally(chunk: pa.Table, got: pa.Table) -> pa.Table:
        own, _ = _tokens(chunk.to_pylist()[0])
        bucket, after, alone = estimates(own, *_answers(got, True), totals.rest_tokens, totals.rest_documents)
        steps = []
        for p in (after, alone):
            with np.errstate(divide="ignore"):
                steps.append(np.where(p > 0, np.rint(STEPS * np.log2(p)), -1e6).astype(np.int64))
        cells, n = np.unique(np.column_stack([bucket, *steps]), axis=0, return_counts=True)
        return pa.table([
            pa.array(cells[:, 0], pa.int32()), *(pa.array(cells[:, k], pa.int32(), mask=cells[:, k] == -1_000_000) for k in (1, 2)),
            pa.array(n, pa.int64())], names=["bucket", "after", "alone", "n"])

    held = met([t.where("held_back") for t in (chunks, answers)])
    cells = held[0].cogroup(held[1]).applyInArrow(tally, "bucket int, after int, alone int, n long")
    cells = cells.groupBy("bucket", "after", "alone").agg(F.sum("n").alias("n")).collect()
    return learned(sorted((tuple(c) for c in cells), key=str), totals.rest_kinds)


def parts_of(key: str, modulus: int = 5, scored_only: int = 1) -> Column:
    """By crc32 of the id as text (null: empty): not trained on where the remainder is `scored_only`, and
    of the others one in `DELETED` by the quotient held back."""
    crc = F.crc32(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")).cast("binary"))
    back = F.floor(crc / modulus) % DELETED == 0
    return F.when(crc % modulus == scored_only, SCORED).when(back, HELD_BACK).otherwise(TRAINED)


def with_scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", part: Column | None = None,
    chunk_bytes: int = CHUNK_BYTES, range_tokens: int = RANGE_TOKENS,
) -> DataFrame:
    """By row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end; a null text is empty and so
    is its end alone. `part` says which rows are only scored, trained on, or held back for the
    weights (default: `parts_of` the key). Rows with one id are documents like others. Where
    nothing is trained on, every token has the probability 1 of the one class there is. Where nothing is held
    back, the three estimates weigh alike. An empty table has no rows.
    """
    chunks = chunks_of(docs, key, text, parts_of(key) if part is None else part, chunk_bytes)
    answers, totals = counted(chunks, range_tokens)
    weights = learn(chunks, answers, totals)

    def score(chunk: pa.Table, got: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        own, _ = _tokens(row)
        words, bigrams = _answers(got, False)
        bucket, after, alone = estimates(own, words, bigrams, totals.tokens, totals.documents)
        mixed = weights[bucket, 0] * after + weights[bucket, 1] * alone + weights[bucket, 2] / (totals.kinds + 1)
        if not totals.tokens:
            mixed[:] = 1.0
        count = words[own.word]
        base = np.log10((count + 0.5) / (totals.tokens + 0.5 * (totals.kinds + 1)))
        of = lambda values: np.add.reduceat(values, own.first)
        n = len(own.first)
        return pa.table([
            chunk.column("ids").combine_chunks().flatten(), pa.array(np.array(row["parts"]) == SCORED),
            pa.array(np.array(row["lengths"], np.int64)), pa.array(of((count > 0).astype(np.int64))),
            pa.array(np.full(n, totals.tokens, np.int64)), pa.array(of(base)), pa.array(of(np.log10(mixed)))],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[key].dataType.simpleString()
    own, got = met([chunks, answers])
    scored = stored(own.cogroup(got).applyInArrow(
        score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    discard(chunks, answers)
    return scored
