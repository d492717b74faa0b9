"""Tables in the folder that driver and executors share, and runs that can be watched and stopped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="biblion-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in the shared folder, made once, with a folder for each value of ``by``."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Stopped(Exception):
    """A watched run was stopped."""


def watched(spark: SparkSession, work: Callable[[], T], stop: Callable[[], bool] = lambda: False, progress: Callable[[int, int], None] | None = None, every: float = 0.2) -> T:
    """The result of ``work``, whose Spark jobs form a group. ``progress`` hears of finished and all tasks of
    the running stages; once ``stop`` says so the group is cancelled and Stopped is raised."""
    context, group, out = spark.sparkContext, uuid.uuid4().hex, {}

    def run() -> None:
        context.setJobGroup(group, "watched", interruptOnCancel=True)
        try:
            out["result"] = work()
        except BaseException as e:  # noqa: BLE001  handed to the caller below
            out["error"] = e

    thread = InheritableThread(target=run, session=spark)
    thread.start()
    stopped = False
    while thread.is_alive():
        if not stopped and stop():
            stopped = True
        if stopped:
            context.cancelJobGroup(group)  # jobs that have begun since the last look, too
        elif progress:
            tracker = context.statusTracker()
            stages = [s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for i in job.stageIds if (s := tracker.getStageInfo(i))]
            progress(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))
        thread.join(every)
    if stopped:
        raise Stopped
    if "error" in out:
        raise out["error"]
    return out["result"]
