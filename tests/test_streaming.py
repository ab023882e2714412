import datetime as dt
import random

import pandas as pd

from barwright.operators.indicators import rsi_of, smooth
from barwright.streaming import live


def bars(n=60):
    r = random.Random(3)
    return [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), r.uniform(50, 150)) for k in "ab" for i in range(n)]


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).toPandas()


def test_live_indicators_equal_batch(spark, tmp_path):
    rows = bars()
    src = str(tmp_path / "in")
    for cut in (20, 40, 60):
        part = [x for x in rows if cut - 20 <= (x[1] - dt.datetime(2024, 1, 1)).total_seconds() / 3600 < cut]
        late = [x for x in rows if x[1] == dt.datetime(2024, 1, 1)] if cut == 60 else []
        spark.createDataFrame(part + late, "instrument string, ts timestamp, mid double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("instrument string, ts timestamp, mid double").option("maxFilesPerTrigger", 1).parquet(src)
    got = run(spark, live.live_indicators(stream, 10), "live_parity").sort_values(["instrument", "ts"])
    for k in "ab":
        own = got[got.instrument == k]
        x = pd.Series([v for i, _, v in rows if i == k]).to_numpy()
        assert len(own) == len(x)
        assert pd.Series(smooth(x, 10)).round(9).equals(own.ema.reset_index(drop=True).astype(float).round(9))
        assert pd.Series(rsi_of(x, 10)).round(9).equals(own.rsi.reset_index(drop=True).astype(float).round(9))


def test_bars_from_ticks(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    ticks = [("a", t0 + dt.timedelta(minutes=7 * i), i, float((i * 37) % 11)) for i in range(60)]
    src = str(tmp_path / "ticks")
    spark.createDataFrame(ticks, "instrument string, ts timestamp, tick_id int, price double").coalesce(1).write.parquet(src)
    spark.createDataFrame([("a", t0 + dt.timedelta(days=1), 99, 1.0)], "instrument string, ts timestamp, tick_id int, price double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("instrument string, ts timestamp, tick_id int, price double").option("maxFilesPerTrigger", 1).parquet(src)
    got = run(spark, live.bars_from_ticks(stream), "live_bars").sort_values("ts")
    want = {}
    for _, ts, _, p in ticks:
        want.setdefault(ts.replace(minute=0), []).append(p)
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got.itertuples()] == [(v[0], max(v), min(v), v[-1], len(v)) for _, v in sorted(want.items())][: len(got)] and len(got) >= 6


def test_upsert_sink(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = live.upsert_sink(path)
    schema = "k string, v int"
    write(spark.createDataFrame([("a", 1), ("b", 1)], schema), 0)
    for _ in range(2):  # a batch that is repeated
        write(spark.createDataFrame([("a", 2)], schema), 1)
    assert sorted(tuple(r) for r in live.read_upserted(spark, path, ["k"]).collect()) == [("a", 2), ("b", 1)]
