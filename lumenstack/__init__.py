"""Spark-native analytics of frame sequences and traces."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Let Python workers find this package where the driver found it, if it is not installed or on their path already."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [env.get("PYTHONPATH")])])
