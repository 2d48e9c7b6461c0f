"""Byte-level convolutional quality classifier in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Learned filters slide
over each chunk, their activations are max-pooled in the chunk, and the mean and the maximum
over all chunks feed one small dense layer that gives the probability. Repeated text leaves
most filters silent in every chunk, odd characters excite others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tandem.llm.frames import free_name, others, quoted, text_bytes
from tandem.llm.labelled import training_sample
from tandem.llm.text import byte_arrays, slices

CHUNK, STEP = 512, 448
WIDTH, STRIDE = 8, 4
EMBED, FILTERS, HIDDEN = 6, 32, 24
PAD = 256
BLOCK = 512  # chunks computed at once

TRAIN_ROWS = 4_000
STEPS = 700  # of 48 documents each, whatever the sample's size


@dataclass
class Network:
    """Weights; picklable, some 10 kB."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def new_network(seed: int = 4) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        draw(PAD + 1, EMBED, scale=0.5), draw(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
        np.zeros(FILTERS, np.float32), draw(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
        np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=HIDDEN ** -0.5), np.zeros(1, np.float32))


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk and the first chunk of each row (one more entry). Every row has one at least."""
    lengths = np.diff(offsets)
    counts = 1 + np.maximum(0, -(-(lengths - CHUNK) // STEP))
    first = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.repeat(offsets[:-1], counts) + place * STEP, first


def _symbols(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < stops[:, None]
    if not len(data):
        return np.full(at.shape, PAD, np.int16)
    # Not as bytes: padding is a symbol beyond them.
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(PAD))


def _windows(net: Network, symbols: np.ndarray) -> np.ndarray:
    half = net.embed[symbols].reshape(len(symbols), CHUNK // STRIDE, STRIDE * EMBED)
    return np.concatenate([half[:, :-1], half[:, 1:]], 2)


def pooled(net: Network, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's largest activation of each filter (after ReLU), and where it was."""
    active = _windows(net, symbols) @ net.filters
    where = active.argmax(1)
    top = np.take_along_axis(active, where[:, None], 1)[:, 0] + net.bias
    return np.maximum(top, 0), where


def _documents(top: np.ndarray, first: np.ndarray) -> np.ndarray:
    starts = first[:-1]
    return np.hstack([np.add.reduceat(top, starts) / np.diff(first)[:, None], np.maximum.reduceat(top, starts)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One probability per row; a row without bytes is one chunk of padding."""
    if len(offsets) < 2:
        return np.zeros(0)
    starts, first = chunks_of(data, offsets)
    stops = np.repeat(offsets[1:], np.diff(first))
    # The largest activation is wanted only, not its place: a plain maximum is cheaper.
    top = np.concatenate([
        np.maximum((_windows(net, _symbols(data, starts[i:i + BLOCK], stops[i:i + BLOCK])) @ net.filters).max(1) + net.bias, 0)
        for i in range(0, len(starts), BLOCK)])
    hidden = np.maximum(_documents(top, first) @ net.dense + net.dense_bias, 0)
    return _sigmoid((hidden @ net.out + net.out_bias[0]).astype(np.float64))


def _gradients(net: Network, symbols: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    top, where = pooled(net, symbols)
    docs = _documents(top, first)
    hidden = np.maximum(docs @ net.dense + net.dense_bias, 0)
    error = ((_sigmoid(hidden @ net.out + net.out_bias[0]) - y) / len(y)).astype(np.float32)
    back = error[:, None] * net.out * (hidden > 0)
    to_docs = back @ net.dense.T
    counts = np.diff(first)
    row = np.repeat(np.arange(len(y)), counts)
    mean, most = to_docs[:, :FILTERS], to_docs[:, FILTERS:]
    is_top = top == docs[row, FILTERS:]
    ties = np.maximum(np.add.reduceat(is_top.astype(np.float32), first[:-1]), 1)
    to_top = (mean[row] / counts[row, None] + is_top * most[row] / ties[row]) * (top > 0)
    # A maximum passes its gradient to one window only, so this is sparse.
    chunk = np.arange(len(top))[:, None]
    seen = symbols[chunk[:, :, None], (where * STRIDE)[:, :, None] + np.arange(WIDTH)]
    inputs = net.embed[seen].reshape(len(top), FILTERS, WIDTH * EMBED)
    to_filters = np.einsum("cf,cfi->if", to_top, inputs)
    to_inputs = to_top[:, :, None] * net.filters.T[None]
    to_embed = np.zeros_like(net.embed)
    flat = to_inputs.reshape(-1, EMBED)
    for d in range(EMBED):
        to_embed[:, d] = np.bincount(seen.ravel(), flat[:, d], PAD + 1)
    return [to_embed, to_filters, to_top.sum(0), docs.T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True)]


def train(sample: list[tuple[bytes, int]], steps: int = STEPS, seed: int = 4, rate: float = 4e-3) -> Network:
    """Adam on the log loss over whole documents. An empty sample gives the untrained network's
    neutral form (0.5 everywhere), a sample of one class nearly that class."""
    net = new_network(seed)
    if not sample:
        net.out[:] = 0
        return net
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in sample], np.float32)
    share = np.clip(y.mean(), 0.02, 0.98)
    net.out_bias[:] = np.log(share / (1 - share))
    names = [f.name for f in fields(net)]
    moment, spread = [0.0] * len(names), [0.0] * len(names)
    batch = 48
    order = np.zeros(0, int)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, *(rng.permutation(len(sample)) for _ in range(-(-batch // len(sample))))])
        rows, order = order[:batch], order[batch:]
        texts = [sample[r][0] for r in rows]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts, first = chunks_of(data, offsets)
        symbols = _symbols(data, starts, np.repeat(offsets[1:], np.diff(first)))
        now = rate * min(1, step / 20) * (1 - step / (steps + 1))
        for k, g in enumerate(_gradients(net, symbols, first, y[rows])):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            change = now * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(spread[k] / (1 - 0.99 ** step)) + 1e-7)
            weights = getattr(net, names[k])
            weights -= change.astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> Network:
    """Train on a bounded sample of rows that are not held out."""
    return train(training_sample(docs, labels, "quality", rows, key, text))


def with_score(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` plus the probability of good quality as `name`, which replaces a column of that name.

    Null and empty texts get the padding chunk's score.
    """

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, held):
            found = probabilities(net, *byte_arrays(batch.column(held)))
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names)

    before, held = others(docs, name), free_name(docs, "__bytes")
    names = [*before, name]
    schema = StructType([*(docs.schema[c] for c in before), StructField(name, DoubleType())])
    return docs.select(*map(quoted, before), text_bytes(text).alias(held)).mapInArrow(score, schema)
