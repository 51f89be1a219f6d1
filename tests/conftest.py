import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def node_metrics():
    """Runs a query and gives a metric of all nodes of its plan whose description holds a text."""

    def run(frame, holds, metric="numOutputRows"):
        frame.collect()
        out, open_ = [], [frame._jdf.queryExecution().executedPlan()]
        while open_:
            node = open_.pop()
            if holds in node.nodeName() + " " + node.simpleString(200):
                found = node.metrics().get(metric)
                out += [found.get().value()] if found.isDefined() else []
            if node.nodeName() == "AdaptiveSparkPlan":
                open_.append(node.executedPlan())
            elif "QueryStage" in node.nodeName():
                open_.append(node.plan())
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
        return out

    return run
