"""Hourly last values: the stream's rows are those of the same operation over the whole table."""

import random
from datetime import datetime, timedelta

from quartzline.streaming.hourly import last_of_hour


def test_stream_equals_table(spark, tmp_path):
    rng, start = random.Random(8), datetime(2024, 1, 1)
    schema = "seq long, market string, at timestamp, price double"
    rows = [(k, rng.choice(["a", "b", None]), start + timedelta(minutes=10 * k + rng.randrange(0, 20)), rng.choice([None, rng.random()])) for k in range(120)]
    rows += [(120 + k, "a", rows[k][2], 2.0) for k in range(3)] + [(130, "b", None, 1.0)]
    rows.sort(key=lambda r: r[0] if r[0] < 120 else r[0] - 120)
    cut = len(rows) // 4 + 1
    for part in range(4):
        spark.createDataFrame(rows[part * cut : (part + 1) * cut], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    closing = [(999, "end", start + timedelta(days=3), 0.0)]
    spark.createDataFrame(closing, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def ask(df):
        return last_of_hour(df, ["market"], "at", ["price", "seq"], "seq", "1 hour")

    stream = ask(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (str(r.market), r.hour)
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key)
    want = {}
    for seq, market, at, price in rows:
        if at:
            hour = (market, at.replace(minute=0, second=0))
            want[hour] = max(want.get(hour, (at, seq, price)), (at, seq, price), key=lambda x: x[:2])
    assert [(r.market, r.hour, r.seq, r.price) for r in got] == sorted([(m, h, s, p) for (m, h), (_, s, p) in want.items()], key=lambda x: (str(x[0]), x[1]))
    table = ask(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, table.select("market", "hour", "seq", "price").collect()), key=str) == sorted([(r.market, r.hour, r.seq, r.price) for r in got], key=str)
