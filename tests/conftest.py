from __future__ import annotations

import pytest
from feeds import write_feed
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", tmp_path_factory.mktemp("checkpoints").as_uri()).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def valley(spark, tmp_path_factory):
    from headway.sources.gtfs import load_feed

    return load_feed(spark, write_feed(tmp_path_factory.mktemp("valley") / "feed")).snapshot()
