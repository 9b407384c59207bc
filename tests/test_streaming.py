from pyspark.sql import functions as F

from tamiz.operators import changefeed, suggest
from tamiz.schema import DOCUMENT
from tamiz.streaming import sinks


def test_upsert_stream_restarts(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    schema = "gen long, seq long, op string, id long, title string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = changefeed.normalize(spark.readStream.schema(schema).parquet(source), F.col("id"), F.col("op"), {"gen": F.col("gen"), "seq": F.col("seq")}, F.struct("title"))
        sinks.upsert_stream(stream, sinks.state_at(path), check, available_now=True).awaitTermination()
        batch = changefeed.normalize(spark.createDataFrame([], schema), F.col("id"), F.col("op"), {"gen": F.col("gen"), "seq": F.col("seq")}, F.struct("title"))
        return sorted((r.key, r.content.title) for r in changefeed.live(sinks.state_at(path)(batch).read()).collect())

    assert run([(0, 1, "index", 1, "a"), (0, 3, "delete", 2, None)]) == [(1, "a")]
    assert run([(0, 2, "index", 2, "late"), (1, 0, "index", 1, "b"), (1, 0, "index", 1, "b")]) == [(1, "b")]


def test_suggest_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(i, t, "", 1.0, "c", {}) for i, t in enumerate(["wireless mouse", "wireless keyboard", "wired"])], DOCUMENT).write.parquet(source)
    seen = []
    stream = spark.readStream.schema(DOCUMENT).parquet(source)
    sinks.suggest_stream(stream, lambda df: seen.append([r.term for r in suggest.lookup(suggest.build(df, 1), "wir", 5).collect()]), str(tmp_path / "check"), available_now=True).awaitTermination()
    assert seen[-1] == ["wireless", "wired"]


def test_replicate_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    for _ in range(2):
        sinks.replicate_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
