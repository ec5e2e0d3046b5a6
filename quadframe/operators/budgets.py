"""Time budgets: Spark jobs that are cancelled when a request's time is over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from ..errors import InvalidArgument, Timeout
from .datasets import Capability

#: Milliseconds by default, and what no grant can exceed.
BASE, CEILING = 5_000, 120_000
R = TypeVar("R")


def effective(capability: Capability, budget: int | None = None) -> int:
    """Milliseconds a request may take: grants raise the base to the ceiling, the argument only lowers it."""
    if budget is not None and (isinstance(budget, bool) or not isinstance(budget, int) or budget <= 0):
        raise InvalidArgument("budget", "it must be a positive whole number of milliseconds")
    most = CEILING if capability.root else min(CEILING, max([BASE, *capability.numbers("budget:")]))
    return min(most, budget or most)


def within(spark: SparkSession, milliseconds: int, work: Callable[[], R]) -> R:
    """``work()``, whose Spark jobs form a group that a timer cancels; then nothing of it is answered."""
    group, over = f"quadframe-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobGroup(group)

    spark.sparkContext.setJobGroup(group, "bounded request", interruptOnCancel=True)
    timer = threading.Timer(milliseconds / 1000, stop)
    timer.start()
    try:
        answer = work()
    except Exception as e:
        if over.is_set():
            raise Timeout(f"refused: it took more than {milliseconds} ms") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(name, None)
    if over.is_set():
        raise Timeout(f"refused: it took more than {milliseconds} ms")
    return answer
