import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(monkeypatch):
    """Shrink all block sizes, so that short fixtures take the paths of long series."""
    from tidelag.operators import neighbors, ranking

    monkeypatch.setattr(neighbors, "TILE", 16)
    monkeypatch.setattr(neighbors, "FEW", 5)
    monkeypatch.setattr(neighbors, "MANY", 9)
    monkeypatch.setattr(neighbors, "ANSWERS", 64)
    monkeypatch.setattr(ranking, "SHORT", 60)
    monkeypatch.setattr(ranking, "BOX_POINTS", 16)
    monkeypatch.setattr(ranking, "SAMPLE", 40)
    monkeypatch.setattr(ranking, "DEPTH", 2)
    monkeypatch.setattr(neighbors, "DRAWS", 2)
    monkeypatch.setattr(neighbors, "TOGETHER", 2)
    monkeypatch.setattr(neighbors, "POINTS", 7)
    monkeypatch.setattr(neighbors, "BLOCKS", "(n + 6) div 7")
