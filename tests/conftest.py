from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def broadcast_scans(df) -> list[list[str]]:
    """Of each broadcast in the plan of ``df`` the steps below it, as the planner chose them."""
    lines = df._jdf.queryExecution().executedPlan().treeString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x.strip(" :+-"))
            out.append(below)
    return out
