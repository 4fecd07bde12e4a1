import random

from weftline.operators.intervals import periods_and_gaps
from weftline.streaming.intervals import streamed_periods


def test_streamed_periods_equal_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), s, s + rng.randrange(1, 30)) for s in (rng.randrange(400) for _ in range(80))] + [("a", None, 3), ("b", 5, 5)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    for i in range(3):
        spark.createDataFrame(rows[i::3], df.schema).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in/*"))
    seen: dict = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.k, r.zone] = (r.starts, r.ends)

    query = streamed_periods(stream, ["k"], "s", "e", 64).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    pieces = spark.createDataFrame([(k, a, b) for (k, _), (s, e) in seen.items() for a, b in zip(s, e, strict=True)], df.schema)
    want = {tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e").collect()}
    assert {tuple(r) for r in periods_and_gaps(pieces, ["k"], "s", "e").collect()} == want
