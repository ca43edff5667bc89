"""Grades with a deadline: a task of Spark keeps one child process, and a grade that takes too long costs that child and no more.

    with deadline(30):
        report = evaluate(task, samples, responses)

Within the block, graders that work in Python are built with that limit: what isn't decided in time counts as wrong and as ``n_timed_out``.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from multiprocessing import get_context
from multiprocessing.connection import Connection

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

DONE, TIMED_OUT, FAILED = "done", "timed_out", "failed"
#: How long a child may take to begin, in seconds: that is no part of a grade.
START = 120.0
_limit: ContextVar[float | None] = ContextVar("limit", default=None)


@contextmanager
def deadline(seconds: float) -> Iterator[None]:
    """Graders built inside have so many seconds a pair."""
    if not seconds > 0:
        raise ValueError("a deadline is above 0 seconds")
    token = _limit.set(seconds)
    try:
        yield
    finally:
        _limit.reset(token)


def limit() -> float | None:
    return _limit.get()


def _serve(questions: Connection, work: bytes, parent: int) -> None:
    """A child's life: answers one question after another, until nobody asks; it goes when its parent goes, whatever it is at."""

    def watch() -> None:
        while os.getppid() == parent:
            time.sleep(1)
        os._exit(1)

    threading.Thread(target=watch, daemon=True).start()
    test = cloudpickle.loads(work)
    questions.send(True)
    while True:
        try:
            pair = questions.recv()
        except EOFError:
            return
        try:
            answer = (bool(test(*pair)), DONE)
        except Exception:  # noqa: BLE001  any error of a grader is a verdict
            answer = (None, FAILED)
        questions.send(answer)


class Child:
    """A process that applies a test to pairs, started when first asked and again after it had to be killed or died."""

    def __init__(self, test: Callable[..., bool], seconds: float):
        self.work, self.seconds, self.starts = cloudpickle.dumps(test), seconds, 0
        self._process = self._pipe = None

    def _begin(self) -> None:
        context = get_context("spawn")
        self._pipe, theirs = context.Pipe()
        self._process = context.Process(target=_serve, args=(theirs, self.work, os.getpid()), daemon=True)
        self._process.start()
        theirs.close()
        self.starts += 1
        if not self._pipe.poll(START):
            self.end()
            raise TimeoutError(f"a grader did not begin within {START} seconds")
        self._pipe.recv()

    def ask(self, *pair: object) -> tuple[bool | None, str]:
        if self._process is None:
            self._begin()
        try:
            self._pipe.send(pair)
            if self._pipe.poll(self.seconds):
                return self._pipe.recv()
            verdict = TIMED_OUT
        except (EOFError, OSError):  # the child died, for example for lack of memory
            verdict = FAILED
        self.end()
        return None, verdict

    def end(self) -> None:
        if self._process is not None:
            self._process.kill()
            self._process.join()
            self._pipe.close()
            self._process = self._pipe = None


def graded(test: Callable[[str, str], bool], seconds: float) -> Callable[[Column, Column], Column]:
    """A column function of pairs: struct (value boolean, verdict string: done, timed_out or failed; value is null unless done).

    Equal texts are true and nulls false without a child. Rows are sent to the child one by one, as each has a deadline of its own.
    """

    @F.pandas_udf("value boolean, verdict string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        child = Child(test, seconds)
        try:
            for predictions, truths in batches:
                out = [(None, DONE) if p is None or t is None else child.ask(p, t) for p, t in zip(predictions, truths, strict=True)]
                yield pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype="object"), "verdict": [w for _, w in out]})
        finally:
            child.end()

    def column(prediction: Column, truth: Column) -> Column:
        open_ = prediction != truth
        sent = of(F.when(open_, prediction), F.when(open_, truth))
        plain = lambda v: F.struct(F.lit(v).alias("value"), F.lit(DONE).alias("verdict"))
        return F.when(prediction.isNull() | truth.isNull(), plain(False)).when(prediction == truth, plain(True)).otherwise(sent)

    return column
