"""Named work: how far it is, and stopping it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Progress:
    jobs: int
    stages: int
    tasks: int
    done: int
    failed: int


@contextmanager
def named(spark: SparkSession, name: str) -> Iterator[None]:
    """Spark jobs that this thread starts inside belong to `name`; cancel() interrupts their tasks."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
    context.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])


def progress(spark: SparkSession, name: str) -> Progress:
    """Tasks of all jobs so far that belong to `name`."""
    tracker = spark.sparkContext.statusTracker()
    ids = tracker.getJobIdsForGroup(name)
    known = [(info.status, tracker.getStageInfo(s)) for j in ids if (info := tracker.getJobInfo(j)) for s in info.stageIds]
    # of jobs that have ended, stages without any task were skipped
    stages = [s for status, s in known if s and not (status == "SUCCEEDED" and not s.numCompletedTasks)]
    return Progress(len(ids), len(stages), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages), sum(s.numFailedTasks for s in stages))


def cancel(spark: SparkSession, name: str) -> None:
    """Stops what `name` runs; what it had not committed has no effect."""
    spark.sparkContext.cancelJobGroup(name)
