"""A wall-clock budget that also holds inside a plan (O-17).

Every Spark job started under a :class:`Budget` carries its tag.  After the
deadline a timer thread cancels the tagged jobs, and goes on doing so until the
block is left, because a model fit that lost one job would start the next.
Threads started in the block carry the tag if they inherit local properties
(``pyspark.inheritable_thread_target``).
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession

POLL_S = 0.2


class Budget:
    """Context manager: tagged jobs end at ``seconds`` after ``started`` (a ``perf_counter`` reading).

    With ``armed=False`` nothing is cancelled before :meth:`arm` is called,
    even past the deadline.
    """

    def __init__(self, spark: SparkSession, seconds: float, started: float | None = None, armed: bool = True):
        self.sc = spark.sparkContext
        self.deadline = (time.perf_counter() if started is None else started) + seconds
        self.tag = f"quarry-budget-{uuid.uuid4().hex[:12]}"
        self._armed, self._left = threading.Event(), threading.Event()
        if armed:
            self._armed.set()
        self._timer = threading.Thread(target=self._watch, daemon=True)

    def _watch(self):
        while not self._left.is_set():
            wait = self.deadline - time.perf_counter()
            if wait > 0:
                self._left.wait(wait)
            elif not self._armed.is_set():
                self._armed.wait(POLL_S)
            else:
                self.sc.cancelJobsWithTag(self.tag)
                self._left.wait(POLL_S)

    def arm(self) -> None:
        self._armed.set()

    @property
    def armed(self) -> bool:
        return self._armed.is_set()

    @property
    def spent(self) -> bool:
        return time.perf_counter() >= self.deadline

    def __enter__(self):
        self.sc.addJobTag(self.tag)
        self.sc.setInterruptOnCancel(True)  # tasks of a cancelled job give their slots back at once
        self._timer.start()
        return self

    def __exit__(self, *_):
        self._left.set()
        self._timer.join()
        self.sc.removeJobTag(self.tag)
        self.sc.setInterruptOnCancel(False)
