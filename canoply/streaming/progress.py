"""Progress of runs: percentages, and gaps that repeat what was said last.

The plans below work on a table of events; ``latest`` keeps the last state of each run from a stream.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percent(status: Column) -> Column:
    """0..1 as 0..100, halves away from zero."""
    return F.round(F.round(status * 100, 9)).cast("int")


def filled(events: DataFrame) -> DataFrame:
    """(run, seq, status, message): a negative status and an empty message repeat the last of the run (else 0 and '')."""
    so_far = W.partitionBy("run").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    status = F.last(F.when(F.col("status") >= 0, F.col("status")), ignorenulls=True).over(so_far)
    message = F.last(F.nullif(F.col("message"), F.lit("")), ignorenulls=True).over(so_far)
    return events.select("run", "seq", F.coalesce(status, F.lit(0.0)).alias("status"), F.coalesce(message, F.lit("")).alias("message"))


def latest(events: DataFrame) -> DataFrame:
    """The state of each run, also of a streaming table (complete or update mode)."""
    said = F.when(F.col("status") >= 0, F.col("seq"))
    told = F.when(F.coalesce("message", F.lit("")) != "", F.col("seq"))
    return events.groupBy("run").agg(F.max("seq").alias("seq"), F.coalesce(F.max_by("status", said), F.lit(0.0)).alias("status"), F.coalesce(F.max_by("message", told), F.lit("")).alias("message"))


class Clock:
    """Tells the seconds since its beginning, at once, with every tick, and at the end."""

    def __init__(self, told: Callable[[float], None], tick: float = 1.0):
        self.told, self.tick, self.ended = told, tick, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def seconds(self) -> float:
        return time.monotonic() - self.began

    def _run(self) -> None:
        while not self.ended.wait(self.tick):
            self.told(self.seconds())

    def __enter__(self) -> Clock:
        self.began = time.monotonic()
        self.told(0.0)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.thread.join()
        self.told(self.seconds())


class Watch:
    """Tells how far the Spark jobs of a block are, from 0 to 1 and never back, and ends them once stop is set.

    The jobs form a group, which Spark's status tracker is asked about with every tick. How many jobs will come isn't known, so each takes
    half of what is left: with n done and the tasks of those under way done to a share x, 1 - (1 - x / 2) / 2**n.
    """

    def __init__(self, spark: SparkSession, message: str, told: Callable[[float], None], stop: threading.Event, tick: float = 0.2):
        self.sc, self.message, self.told, self.stop, self.tick = spark.sparkContext, message, told, stop, tick
        self.group, self.ended, self.last = f"canoply-{uuid.uuid4().hex}", threading.Event(), 0.0
        self.thread = threading.Thread(target=self._run, daemon=True)

    def share(self) -> float:
        tracker, done, tasks, over = self.sc.statusTracker(), 0, 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            if info is None or info.status == "SUCCEEDED":
                done += 1
                continue
            for stage in map(tracker.getStageInfo, info.stageIds):
                if stage is not None:
                    tasks, over = tasks + stage.numTasks, over + stage.numCompletedTasks
        return 1 - (1 - (over / tasks if tasks else 0) / 2) / 2**done

    def _tell(self, share: float) -> None:
        if share > self.last or share == 0:
            self.last = share
            self.told(share)

    def _run(self) -> None:
        while not self.ended.wait(self.tick):
            if self.stop.is_set():
                self.sc.cancelJobGroup(self.group)
            else:
                self._tell(self.share())

    def __enter__(self) -> Watch:
        self.sc.setJobGroup(self.group, self.message, interruptOnCancel=True)
        self._tell(0.0)
        self.thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self.ended.set()
        self.thread.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.sc.setLocalProperty(name, None)
        if kind is None:
            self._tell(1.0)
