"""The driver's tables as field data, and the same views as SQL text.

Each view covers its whole table; only the columns it needs are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.functions.grid import int_div

# Shape of the gridded view, cells of a box, cells of a frame.
TIMESTEPS = 6
NX, NY = 10, 5
BOX = (5, 5, 5)
FRAME = 500
FRAME_GRID = (10, 5, 10)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def field(spark: SparkSession, sf: str) -> DataFrame:
    """Gridded series: timestep, point_id, gx, gy, gz, u, v, w."""
    point = int_div("o_orderkey", TIMESTEPS)
    return table(spark, sf, "orders").select(
        F.pmod("o_orderkey", F.lit(TIMESTEPS)).cast("long").alias("timestep"),
        point.alias("point_id"),
        F.pmod(point, F.lit(NX)).alias("gx"),
        F.pmod(int_div(point, NX), F.lit(NY)).alias("gy"),
        int_div(point, NX * NY).alias("gz"),
        F.col("o_totalprice").alias("u"),
        F.col("o_custkey").cast("double").alias("v"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double").alias("w"),
    )


FIELD = """field AS (
  SELECT o_orderkey % 6 AS timestep, o_orderkey // 6 AS point_id, (o_orderkey // 6) % 10 AS gx,
         (o_orderkey // 60) % 5 AS gy, o_orderkey // 300 AS gz, o_totalprice AS u,
         CAST(o_custkey AS DOUBLE) AS v,
         CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS w
  FROM orders)"""


def depth(cells: DataFrame) -> int:
    """Planes of the gridded view: one more than the largest gz."""
    return cells.agg(F.max("gz")).first()[0] + 1


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of a fixed size: their number, not their size, grows."""
    cell = F.pmod("o_orderkey", F.lit(FRAME))
    return table(spark, sf, "orders").select(
        int_div("o_orderkey", FRAME).alias("frame"),
        cell.alias("cell"),
        F.pmod(cell, F.lit(10)).alias("gx"),
        F.pmod(int_div(cell, 10), F.lit(5)).alias("gy"),
        int_div(cell, 50).alias("gz"),
        F.col("o_totalprice").alias("u"),
        F.col("o_custkey").cast("double").alias("v"),
    )


FRAMES = """frames AS (
  SELECT o_orderkey // 500 AS frame, o_orderkey % 500 AS cell, o_orderkey % 10 AS gx,
         (o_orderkey % 500) // 10 % 5 AS gy, (o_orderkey % 500) // 50 AS gz,
         o_totalprice AS u, CAST(o_custkey AS DOUBLE) AS v
  FROM orders)"""


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    """Point cloud: timestep, point_id, x0, x1."""
    return table(spark, sf, "events").select(
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("timestep"),
        F.col("event_id").alias("point_id"),
        F.col("value").alias("x0"),
        F.get_json_object("props", "$.k").cast("double").alias("x1"),
    )


CLOUD = """cloud AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS timestep, event_id AS point_id,
         value AS x0, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS x1
  FROM events)"""


#: The components of an embedding.
COMPONENTS = [f"e{i}" for i in range(64)]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with their components as columns e0, e1, ..."""
    return table(spark, sf, "embeddings").select(
        F.lit(0).cast("long").alias("timestep"),
        F.col("vec_id").alias("point_id"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COMPONENTS)],
    )


VECTORS = f"""vectors AS (
  SELECT CAST(0 AS BIGINT) AS timestep, vec_id AS point_id,
         {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(COMPONENTS))}
  FROM embeddings)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))


DOCS = "docs AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS n_chars FROM documents)"


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Distributions: quantity, price, discount, tax by year of shipping."""
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("timestep"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


LINE_ITEMS = """li AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS timestep, l_quantity AS quantity, l_extendedprice AS price,
         l_discount AS discount, l_tax AS tax
  FROM lineitem)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return field(spark, sf).select("timestep", "point_id", F.col("u").alias("y"), (F.col("u") * 0.9 + 1000).alias("yhat"))


PREDICTIONS = f"""{FIELD}, predictions AS (
  SELECT timestep, point_id, u AS y, u * CAST(0.9 AS DOUBLE) + 1000 AS yhat FROM field)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Energy counter snapshots: a node per user, a snapshot per event."""
    k = F.get_json_object("props", "$.k").cast("double")
    counters = {"CPU": 3.0, "Mem": 1.0, "Accel0": 5.0, "Accel1": 6.0, "Accel2": 7.0}
    at = F.col("event_id").cast("double")
    days = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    seconds = days * 86400.0 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("node_id"),
        seconds.cast("double").alias("timestamp"),
        F.col("event_id").alias("phase"),
        *[(at * rate + F.col("value")).alias(name) for name, rate in counters.items()],
        F.when(F.pmod(k, F.lit(10.0)) != 0, at * 8.0 + F.col("value")).alias("Accel3"),
    )


SNAPSHOTS = """snapshots AS (
  SELECT CAST(user_id AS VARCHAR) AS node_id, CAST(floor(epoch(ts)) AS DOUBLE) AS "timestamp", event_id AS phase,
         event_id * 3.0::DOUBLE + value AS CPU, event_id * 1.0::DOUBLE + value AS Mem, event_id * 5.0::DOUBLE + value AS Accel0,
         event_id * 6.0::DOUBLE + value AS Accel1, event_id * 7.0::DOUBLE + value AS Accel2,
         CASE WHEN CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) % 10 <> 0
              THEN event_id * 8.0::DOUBLE + value END AS Accel3
  FROM events)"""
