"""Budgets of time for the stages of a study.

A stage runs its Spark jobs in a job group of its own.  When its time is over the group is cancelled, running tasks
included, and the stage counts as failed; what it does outside Spark is not interrupted, but its result comes too late
and is not taken.  Failed stages are tried again, with the next way of doing them if there is one.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


class OutOfTime(RuntimeError):
    pass


@dataclass
class Outcome:
    result: Any = None
    error: str | None = None
    seconds: float = 0.0
    tries: int = 0


def limited(spark: SparkSession, name: str, make: Callable[[], Any], seconds: float | None) -> Any:
    """``make()``, or ``OutOfTime`` when it takes longer; no job of it is left then."""
    context = spark.sparkContext
    group = f"{name}-{uuid.uuid4().hex[:8]}"
    over = threading.Event()

    def cancel() -> None:
        over.set()
        while not done.wait(0.2):  # a stage may start one job after another
            context.cancelJobGroup(group)

    done = threading.Event()
    timer = threading.Timer(seconds, cancel) if seconds and seconds > 0 else None
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, name, interruptOnCancel=True)
    if timer:
        timer.daemon = True
        timer.start()
    try:
        out = make()
    except Exception as x:
        if over.is_set():
            raise OutOfTime(f"{name} took longer than {seconds:g} s") from x
        raise
    finally:
        done.set()
        if timer:
            timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", before)
        context.setLocalProperty("spark.job.interruptOnCancel", None)
    if over.is_set():
        raise OutOfTime(f"{name} took longer than {seconds:g} s")
    return out


def attempt(spark: SparkSession, name: str, ways: list[Callable[[], Any]], seconds: float | None = None, retries: int = 1) -> Outcome:
    """The result of the first way that works in time; the last way is tried ``retries`` times more.

    Errors of the caller's own making (KeyboardInterrupt and the like) are not caught.
    """
    out, began = Outcome(), time.monotonic()
    for way in [*ways, *ways[-1:] * retries]:
        out.tries += 1
        try:
            out.result, out.error = limited(spark, name, way, seconds), None
            break
        except Exception as x:  # noqa: BLE001  a stage that fails is told; the others go on
            out.error = f"{type(x).__name__}: {str(x).splitlines()[0] if str(x) else ''}"
    out.seconds = time.monotonic() - began
    return out
