"""Work that can be given up: jobs of one call carry a tag, and are cancelled by it from another thread."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class GaveUp(Exception):
    """The work was given up before its end."""


def within(spark: SparkSession, work: Callable[[], Any], seconds: float | None = None, stop: threading.Event | None = None) -> Any:
    """What work() gives, or GaveUp if it takes longer than `seconds` or `stop` is set: its jobs are cancelled, its tasks interrupted, and
    nothing of what they made comes back. Jobs of other calls go on, and the same work can be done again."""
    context, tag, done = spark.sparkContext, f"boxloom-{uuid.uuid4().hex}", {}
    ended = stop or threading.Event()
    finished = threading.Event()

    def run() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            done["value"] = work()
        except Exception as e:  # told to the caller, below
            done["error"] = e
        finally:
            context.removeJobTag(tag)
            finished.set()

    thread = InheritableThread(target=run, session=spark)
    thread.start()
    waited, step = 0.0, 0.05
    while not finished.wait(step):
        waited += step
        if ended.is_set() or seconds is not None and waited >= seconds:
            # jobs that it starts from here on are cancelled as well
            while not finished.wait(0.2):
                context.cancelJobsWithTag(tag)
            raise GaveUp(f"given up after {waited:.1f} seconds")
    thread.join()
    if "error" in done:
        raise done["error"]
    return done["value"]
