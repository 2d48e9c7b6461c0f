"""Batched calls of a user's model function, and the retrieve-and-translate job."""

from __future__ import annotations

import logging
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Semaphore

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tandem.functions.text import INVALID, PY_SPACE, extract_code, library_of
from tandem.operators.ordering import number_rows
from tandem.plans.documents import Embedder, add_documents
from tandem.plans.retrieval import add_guidelines
from tandem.session import settle

Model = Callable[[list[str]], list[str]]

# Rows per model call and calls per row before giving up.
BATCH_ROWS = 50
MAX_TRIES = 10

PAUSE = 1.0  # seconds after a call that raised

log = logging.getLogger(__name__)


def number_batches(df: DataFrame, order: str, batch_rows: int, name: str = "batch_no") -> DataFrame:
    """Batch number along `order`; the last batch takes the remainder as well."""
    numbered, n = number_rows(df, [F.col(order)], "_at")
    last = max(n // batch_rows, 1) - 1
    batch = F.least(F.floor(F.col("_at") / F.lit(batch_rows)), F.lit(last).cast("long"))
    return numbered.withColumn(name, batch).drop("_at")


def _usable(answer: str | None) -> bool:
    return answer is not None and len(answer) > 1 and answer.strip(PY_SPACE) != ""


def _answer(model: Model, prompts: list[str | None], tries: int, pause: float) -> list[str]:
    """Ask again for the unusable answers alone, at most `tries` calls in all.

    A call that raises is one try of its rows, followed by a pause; null prompts are not asked.
    """
    answers: list[str] = [INVALID] * len(prompts)
    open_rows = [i for i, prompt in enumerate(prompts) if prompt is not None]
    for turn in range(tries):
        if not open_rows:
            break
        try:
            given = model([prompts[i] for i in open_rows])
        except Exception:
            log.warning("model call %d of %d failed", turn + 1, tries, exc_info=True)
            if turn + 1 < tries:
                time.sleep(pause)
            continue
        for at, answer in zip(open_rows, given, strict=True):
            if _usable(answer):
                answers[at] = answer
        open_rows = [i for i in open_rows if answers[i] == INVALID]
    return answers


def _calls_in_flight(
    model: Model, batches: Iterator[list[str | None]], batch_rows: int, tries: int, pause: float, in_flight: int
) -> Iterator[list[str]]:
    """Answers of each batch, in order, with up to `in_flight` calls at a time, also across batches.

    A batch is read as soon as there is room for its first call, so memory is bounded by the calls, and a
    slow call holds back only what comes after it.
    """
    waiting: deque[list[Future]] = deque()
    room = Semaphore(in_flight)

    def call(part: list[str | None]) -> list[str]:
        try:
            return _answer(model, part, tries, pause)
        finally:
            room.release()

    with ThreadPoolExecutor(in_flight) as pool:
        try:
            for texts in batches:
                calls: list[Future] = []
                waiting.append(calls)
                for start in range(0, len(texts), batch_rows):
                    room.acquire()
                    calls.append(pool.submit(call, texts[start : start + batch_rows]))
                while len(waiting) > 1 and all(c.done() for c in waiting[0]):
                    yield [a for c in waiting.popleft() for a in c.result()]
                if len(waiting) > in_flight:
                    yield [a for c in waiting.popleft() for a in c.result()]
            while waiting:
                yield [a for c in waiting.popleft() for a in c.result()]
        finally:
            pool.shutdown(cancel_futures=True)


def batch_infer(
    df: DataFrame,
    load_model: Callable[[], Model],
    prompt: str = "prompt",
    response: str = "response",
    batch_rows: int = BATCH_ROWS,
    tries: int = MAX_TRIES,
    pause: float = PAUSE,
    in_flight: int = 1,
) -> DataFrame:
    """Add the model's answer to each prompt, or `[INVALID]` after the last try and for null prompts.

    A call that raises is tried again after `pause` seconds, so one time-out does not fail
    the job. `load_model` runs once per task on the executor. With `in_flight` above 1 that many calls
    of a task are under way at once, each with retries of its own rows alone, and the model must
    stand calls from several threads: for models behind a network, whose calls wait. Only the
    prompt column goes to Python; the other columns stay in the JVM. Store or `settle` the result
    before two consumers read it, so that no prompt is answered twice.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        texts = (prompts.astype(object).where(prompts.notna(), None).tolist() for prompts in batches)
        for answers in _calls_in_flight(model, texts, batch_rows, tries, pause, in_flight):
            yield pd.Series(answers, dtype=object)

    # Not deterministic, so the optimizer neither repeats nor reorders the calls.
    return df.withColumn(response, ask.asNondeterministic()(F.col(prompt)))


def in_order(df: DataFrame, item: str = "item_id") -> DataFrame:
    """Rows by item, for a sink that promises an order."""
    return df.orderBy(item)


def _chain(
    items: DataFrame, lookup: Callable[[DataFrame], DataFrame], slot: str, load_model: Callable[[], Model],
    language: str, durable: bool,
) -> DataFrame:
    """Identify, let `lookup` add a column `found` for the column `operations`, fill the slot, translate."""
    keep = settle if durable else (lambda df: df)
    named = batch_infer(items, load_model, "identify_prompt", "identified")
    named = keep(named.withColumn("operations", extract_code(F.col("identified"), "JSON")))
    filled = lookup(named).withColumn("prompt", F.replace(F.col("translate_prompt"), F.lit(slot), F.col("found")))
    answered = keep(batch_infer(filled, load_model, "prompt", "response"))
    return answered.withColumn("code", extract_code(F.col("response"), language)).drop("identified", "found")


def retrieve_and_translate(
    items: DataFrame,
    guide: DataFrame,
    load_model: Callable[[], Model],
    language: str = "Python",
    durable: bool = True,
) -> DataFrame:
    """Identify operations, look them up, and translate with the guide text.

    `items`: item_id, identify_prompt, translate_prompt (with a `[GUIDELINES]` slot).
    Adds operations, prompt, response and code. One plan from end to end; with
    `durable` each round of answers is stored before it is used.
    """
    return _chain(items, lambda named: add_guidelines(named, guide, "item_id", "operations", "found"),
                  "[GUIDELINES]", load_model, language, durable)


def retrieve_apis_and_translate(
    items: DataFrame,
    documents: DataFrame,
    load_embedder: Callable[[], Embedder],
    load_model: Callable[[], Model],
    language: str = "Python",
    durable: bool = True,
    store: str | None = None,
) -> DataFrame:
    """Identify operations, find the nearest documents of the target library, and translate with their text.

    `items`: item_id, direction, identify_prompt, translate_prompt (with an `[APIs]` slot). The
    library is that of the direction; items of an unknown direction get no document. For `documents`
    and `store` see `add_documents`. Adds operations, prompt, response and code.
    """
    def lookup(named: DataFrame) -> DataFrame:
        aimed = named.withColumn("_library", library_of(F.col("direction")))
        return add_documents(aimed, documents, load_embedder, "operations", "_library", "found", store=store).drop("_library")

    return _chain(items, lookup, "[APIs]", load_model, language, durable)
