import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellsift.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, "tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def cloud(spark):
    """Three groups; the first holds most rows and half of them share a value."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    sizes = {0: 900, 1: 120, 2: 60}
    parts = []
    at = 0
    for t, n in sizes.items():
        x = rng.gamma(2.0, 10.0, n)
        if t == 0:
            x[: n // 2] = 5.0
        parts.append(pd.DataFrame({"timestep": t, "point_id": range(at, at + n), "x": x, "y": rng.normal(size=n), "w": rng.random(n) + 0.1}))
        at += n
    pdf = pd.concat(parts).sample(frac=1.0, random_state=1)
    df = spark.createDataFrame(pdf).repartition(7).cache()
    df.count()
    df.pdf = pdf
    return df


@pytest.fixture
def grid_cells(spark):
    """A 10 x 6 x 8 grid at four timesteps; values show a wrong axis order."""
    from pyspark.sql import functions as F

    cells = (
        spark.range(4 * 480)
        .withColumn("timestep", F.floor(F.col("id") / 480).cast("long"))
        .withColumn("point_id", F.pmod("id", F.lit(480)))
        .withColumn("gx", F.pmod("point_id", F.lit(10)))
        .withColumn("gy", F.pmod(F.floor(F.col("point_id") / 10), F.lit(6)).cast("long"))
        .withColumn("gz", F.floor(F.col("point_id") / 60).cast("long"))
    )
    base = F.col("gz") * 1000.0 + F.col("gy") * 10 + F.col("gx") + F.col("timestep") * 0.1
    return cells.withColumns(
        {"u": base, "v": F.sin(base), "w": F.cos(base * 3), "p": F.sin(base * 0.01) * F.col("gz"), "pv": F.sin(base * 7)}
    ).drop("id")
