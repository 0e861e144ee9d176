"""Progress of running jobs, as fractions of tasks done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "job int, stage int, tasks int, done int, failed int, fraction double"


def progress(spark: SparkSession) -> DataFrame:
    """(job, stage, tasks, done, failed, fraction) of the stages that run now; no rows if none does. May be
    called from another thread while a saturation goes on."""
    tracker, rows = spark.sparkContext.statusTracker(), []
    for job in tracker.getActiveJobsIds():
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s is not None and s.numTasks:
                rows.append((job, stage, s.numTasks, s.numCompletedTasks, s.numFailedTasks, s.numCompletedTasks / s.numTasks))
    return spark.createDataFrame(rows, SCHEMA)
