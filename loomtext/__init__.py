"""loomtext: ordered, hierarchical and multilingual text analytics on Spark."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Lets Python workers import this package from where the driver has it, whatever their working folder; a cluster
    whose workers do not see that folder is given the package with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
