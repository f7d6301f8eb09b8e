import random

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def trace():
    """A maker of bursty traces: ranked arrivals with ties, a heavy tail of work, noisy scores."""

    def make(n: int, seed: int, limit: int = 60_000_000):
        rng = random.Random(seed)
        t, arrival, service = 0, [], []
        for _ in range(n):
            t += 0 if rng.random() < 0.3 else int(rng.expovariate(1) * 4_000_000)
            arrival.append(t)
            work = rng.uniform(5, 60) if rng.random() < 0.05 else rng.gammavariate(0.4, 5)
            service.append(max(1_000, min(limit, int(work * 1e6))))
        score = [s / 1e6 + rng.gauss(0, 3) for s in service]
        return arrival, service, score

    return make
