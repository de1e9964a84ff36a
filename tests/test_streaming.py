"""Requests arriving as a stream get the answers a batch of them would get."""

from tallyrank.catalog import fixtures as fx
from tallyrank.plans import recommend
from tallyrank.streaming import requests as streaming


def test_stream_equals_batch(spark, sf_dir, tmp_path, sorted_rows):
    requests = fx.requests(spark, sf_dir)
    store = recommend.recommend_all(
        spark, fx.items(spark, sf_dir), fx.lines(spark, sf_dir), fx.TERMS, fx.DEFAULT
    ).cache()
    arrived, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    requests.repartition(3).write.parquet(arrived)
    for _ in range(2):  # the second run finds nothing new
        stream = streaming.read_requests(spark, arrived, requests.schema)
        streaming.answer_requests(stream, store, fx.DEFAULT, out, state).awaitTermination()
    want = recommend.lookup(requests, store, fx.DEFAULT)
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted_rows(got) == sorted_rows(want)


def test_text_flags_reach_their_key(spark):
    store = spark.createDataFrame(
        [("a", "p", "Characters", False, False, 7)],
        "name string, place string, priority string, song boolean, politics boolean, id int",
    )
    asked = spark.createDataFrame(
        [("a", "p", "Characters", "False", "False"), ("a", "p", "Characters", "True", "False")],
        "name string, place string, priority string, song string, politics string",
    )
    got = {r.song: r.id for r in recommend.lookup(asked, store, {"id": -1}).collect()}
    assert got == {False: 7, True: -1}
