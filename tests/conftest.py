import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tasks(spark):
    """tasks(run): the number of tasks that run() has with 50 partitions a shuffle, whatever they hold."""

    def count(run):
        held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
        before, sc, group = {k: spark.conf.get(k) for k in held}, spark.sparkContext, f"tasks-{id(run)}"
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        try:
            run()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            for k, v in before.items():
                spark.conf.set(k, v)
        found = sc.statusTracker()
        stages = [found.getStageInfo(s) for j in found.getJobIdsForGroup(group) for s in found.getJobInfo(j).stageIds]
        return sum(s.numCompletedTasks for s in stages if s)

    return count
