"""A stream of questions to the catalogue: equal ones within a span of time are asked once and answered from what is kept.

What was asked is the stream's state, by question and span; the watermark lets go of spans that are over, so state is bounded by the
questions of two spans. Answers are files, a folder a batch, and a question finds its own by a join, whenever it came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import search_key
from ..operators.catalogue import SEARCH, first_strategy, index, search
from ..sources.storage import scratch, written

ANSWERS = "question string, span_start timestamp, paper_id {id}, strategy int, batch long"
ASKED = "question string, span_start timestamp, batch long"


def question_key() -> Column:
    """Questions with this in common are equal: title, first author, year. Null fields are empty."""
    said = [F.coalesce(c, F.lit("")) for c in (F.col("title"), F.get("authors", F.lit(0)))]
    return search_key(*said, F.col("year"))


def keyed(questions: DataFrame, span: str = "1 hour") -> DataFrame:
    """questions (question_id, asked_at, title, authors, year) + question, span: the span of time that asked_at lies in, from the full hour on."""
    return questions.withColumns({"question": question_key(), "span": F.window("asked_at", span)})


def start(spark: SparkSession, questions_dir: str, schema, papers: DataFrame, searches: Column, out_dir: str, state_dir: str, span: str = "1 hour", files_per_batch: int = 1000) -> StreamingQuery:
    """Asks the catalogue what Parquet files of questions ask, equal ones once a span, and stops when none is left.

    searches: those of `operators.catalogue`, over title, authors and year alone. The catalogue is read and indexed once a start. A
    batch that is run again overwrites its own folders; one that is over isn't run again by a restart. Questions that come
    after their span is over by another span are late: they aren't asked, and are answered only if their span was.
    """
    catalogue = written(papers.select("paper_id", "title", "authors", "year", "doi"), "catalogue")
    at = index(catalogue)

    def each(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            asked = written(batch.select(F.monotonically_increasing_id().alias("ref_id"), "question", F.col("span.start").alias("span_start"), "title", "authors", "year", F.lit(None).cast("string").alias("doi")), "asked")
            found = first_strategy(search(asked, catalogue, searches.cast(f"array<{SEARCH}>"), at=at))
            asked.join(found, "ref_id").select("question", "span_start", "paper_id", "strategy").write.mode("overwrite").parquet(f"{out_dir}/answers/batch={number}")
            asked.select("question", "span_start").write.mode("overwrite").parquet(f"{out_dir}/asked/batch={number}")

    questions = keyed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(questions_dir).withWatermark("asked_at", span), span)
    once = questions.select("question", "span", "title", "authors", "year").dropDuplicates(["question", "span"])  # one column of event time
    return once.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", state_dir).trigger(availableNow=True).start()


def asked(spark: SparkSession, out_dir: str) -> DataFrame:
    """(question, span_start, batch): what was asked."""
    return spark.read.schema(ASKED).parquet(f"{out_dir}/asked")


def answered(questions: DataFrame, out_dir: str, span: str = "1 hour", paper_id: str = "long") -> DataFrame:
    """(question_id, paper_id, strategy): each question's answers, its own or those of an equal one in its span; none is no row."""
    spark = questions.sparkSession
    answers = spark.read.schema(ANSWERS.format(id=paper_id)).parquet(f"{out_dir}/answers")
    own = keyed(questions, span).select("question_id", "question", F.col("span.start").alias("span_start"))
    return own.join(answers, ["question", "span_start"]).select("question_id", "paper_id", "strategy")
