"""The stream of questions: asked once a span, restarts, late rows."""

import datetime

from pyspark.sql import functions as F

from citegauge.operators import catalogue as K
from citegauge.streaming import questions as Q

PAPERS = "paper_id long, title string, authors array<string>, year int, doi string"
SCHEMA = "question_id long, asked_at timestamp, title string, authors array<string>, year int"


def test_equal_questions_are_asked_once_a_span(spark, tmp_path):
    papers = spark.createDataFrame([(1, "The hot title of things", ["Ada Li"], 2000, None), (2, "Another title of things", ["Bo Wu"], 2001, None)], PAPERS)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda hour, minute: datetime.datetime(2024, 1, 1, hour, minute)
    hot, other = ("The hot title of things", ["Ada Li"], 2000), ("Another title of things", ["Bo Wu"], 2001)

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        Q.start(spark, source, spark.createDataFrame([], SCHEMA).schema, papers, K.dblp_searches(), out, state, files_per_batch=1).awaitTermination()

    first = [(k, at(1, k), *hot) for k in range(50)] + [(60, at(1, 5), "  THE hot title of things", ["ada li"], 2000), (61, at(1, 59), *other), (62, at(2, 0), *hot), (63, at(1, 7), None, None, None)]
    arrive(first)
    one = {(r.question, r.span_start.hour): r.batch for r in Q.asked(spark, out).collect()}
    assert sorted(h for _, h in one) == [1, 1, 1, 2] and Q.asked(spark, out).count() == 4
    # a restart asks nothing anew, and what was asked within the span is answered from what is kept
    arrive([(70, at(2, 59), *hot), (71, at(1, 30), *hot)])
    assert Q.asked(spark, out).count() == 4
    # the span is over: asked again; then what comes two spans late isn't asked
    arrive([(80, at(5, 0), *hot)])
    assert Q.asked(spark, out).count() == 5
    arrive([(81, at(1, 10), "Another title of things", ["Nobody Else"], 2001), (82, at(1, 11), *other)])
    assert Q.asked(spark, out).count() == 5
    rows = spark.read.schema(SCHEMA).parquet(source)
    got = {r.question_id: (r.paper_id, r.strategy) for r in Q.answered(rows, out).collect()}
    batch = K.first_strategy(K.search(rows.select(F.col("question_id").alias("ref_id"), "title", "authors", "year"), papers, K.dblp_searches()))
    want = {r.ref_id: (r.paper_id, r.strategy) for r in batch.collect()}
    assert {k: v for k, v in want.items() if k != 81} == got and 81 in want and got[82] == got[61]


def test_scratch_is_cleared(spark, tmp_path):
    from citegauge.sources.storage import scratch, written

    kept = written(spark.range(3), "kept")
    with scratch(spark):
        gone = written(spark.range(3), "gone")
        path = gone.inputFiles()[0]
        with scratch(spark):
            inner = written(spark.range(2), "inner").inputFiles()[0]
        assert gone.count() == 3
    from pathlib import Path

    assert kept.count() == 3 and not any(Path(p.removeprefix("file://")).exists() for p in (path, inner))
