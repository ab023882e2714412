"""Stored backtests: runs, their trades and fills, as three Parquet tables under one folder."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record_run(path: str, trades: DataFrame, strategy: str, params: dict, instrument: str, stage: str, metrics: dict | None = None, created_at: datetime | None = None) -> str:
    """Appends a run; its id. The trades come first, so that a run that is listed is whole: readers start from the runs."""
    spark = trades.sparkSession
    run_id = uuid.uuid4().hex
    t = trades.withColumn("run_id", F.lit(run_id))
    t.write.mode("append").parquet(f"{path}/trades")
    fill = lambda sign, ts, price: F.struct((F.lit(sign) * F.col("units")).alias("units"), F.col(ts).alias("ts"), F.col(price).alias("price"))
    fills = t.select("run_id", "trade_no", F.explode(F.array(fill(1.0, "entry_ts", "entry_price"), fill(-1.0, "exit_ts", "exit_price"))).alias("f"))
    fills.select("run_id", "trade_no", "f.*").write.mode("append").parquet(f"{path}/fills")
    row = [(run_id, created_at or datetime.now(), strategy, instrument, stage, json.dumps(params, sort_keys=True), json.dumps(metrics or {}, sort_keys=True))]
    spark.createDataFrame(row, "run_id string, created_at timestamp_ntz, strategy string, instrument string, stage string, params string, metrics string").coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return run_id


def list_runs(spark: SparkSession, path: str, strategy: str | None = None, instrument: str | None = None, stage: str | None = None) -> DataFrame:
    """Runs that fit the given filters, newest first."""
    runs = spark.read.parquet(f"{path}/runs")
    for c, v in (("strategy", strategy), ("instrument", instrument), ("stage", stage)):
        if v is not None:
            runs = runs.where(F.col(c) == v)
    return runs.orderBy(F.desc("created_at"), "run_id")


def trades_of(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/trades").where(F.col("run_id") == run_id).drop("run_id")
