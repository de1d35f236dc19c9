"""Records of dumps, the catalogue kept by key, running statistics."""

import random

import pytest
from pyspark.sql import functions as F

from citegauge.operators import running as U
from citegauge.plans.queries import _tables
from citegauge.sources import store as K
from citegauge.sources.records import tei_records, xml_records
from citegauge.sources.tei import tei_references

SF = "/root/testdata/sf0.001"


def written_file(tmp_path, text, name="dump.xml"):
    at = tmp_path / name
    at.write_text(text, encoding="utf-8")
    return str(at)


def test_records_of_a_file_in_many_parts(spark, tmp_path):
    """Whatever the parts, each record once; those that have no end are told."""
    bodies = [f'<rec n="{k}">{"é&amp;" * (k % 40)}<x:y a="doi:z">t{k}</x:y>\n</rec>' for k in range(400)]
    mixed = '<?xml version="1.0"?><all xmlns:x="urn:x">' + "\n".join(bodies[:200]) + '<rec n="bad"><a>' + bodies[200] + "</rec >".join(b.removesuffix("</rec>") for b in [*bodies[201:399], ""]) + '<rec/><record>no</record><rec n="empty" />' + bodies[399] + '</all><rec n="cut">'
    path = written_file(tmp_path, mixed)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        rows = xml_records(spark, path, "rec")
        assert rows.rdd.getNumPartitions() > 5
        rows = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good = sorted(r.record.replace(' xmlns:x="x"', "") for r in rows if r.error is None)
    assert good == sorted([*bodies, "<rec/>", '<rec n="empty" />'])
    assert sorted(r.record[:13] for r in rows if r.error == "unclosed") == ['<rec n="bad">', '<rec n="cut">']


def test_records_are_those_of_the_document_parser(spark, tmp_path):
    entry = '<biblStruct xml:id="b{0}"><analytic><title level="a">T {0} &lt;x&gt;</title><author><persName><forename>Ada</forename><surname>L{0}</surname></persName></author></analytic><monogr><title level="j">V</title><imprint><date when="20{0:02d}"/></imprint></monogr></biblStruct>'
    body = "".join(entry.format(k) for k in range(30)) + '<biblStruct xml:id="none"/>'
    path = written_file(tmp_path, f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><listBibl>{body}</listBibl></TEI>')
    whole = tei_references(spark.createDataFrame([("d", f"<TEI><listBibl>{body}</listBibl></TEI>")], "doc string, xml string"))
    got = tei_records(spark, path)
    names = ["title", "venue", "year"]
    assert sorted(tuple(r) for r in got.where("error is null").select(*names, F.array_join("authors", ";")).collect()) == sorted(tuple(r) for r in whole.select(*names, F.array_join("authors", ";")).collect())
    assert [(r.id, r.error) for r in got.where("error is not null").collect()] == [("none", "no reference")]
    broken = written_file(tmp_path, "<TEI>" + entry.format(1).replace("<analytic>", "<analytic><b>") + "<biblStruct><analytic>", "broken.xml")
    assert sorted((r.id, r.error, bool(r.raw_text)) for r in tei_records(spark, broken).collect()) == [("", "unclosed", True), ("b1", "no reference", True)]
    assert tei_records(spark, written_file(tmp_path, "", "empty.xml")).count() == 0


def test_lookups_leave_the_catalogue_where_it_is(spark):
    refs, papers = _tables(spark, SF)
    odd = papers.limit(3).withColumn("doi", F.lit("")).withColumn("paper_id", F.col("paper_id") + 1_000_000)
    store = K.save(papers.union(odd), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for found in (K.by_doi(refs.select("ref_id", "doi"), store), K.by_id(refs.select((F.col("ref_id") + 0).alias("asked")), store, "asked")):
            plan = found._jdf.queryExecution().sparkPlan().toString() and found._jdf.queryExecution().executedPlan().toString()
            lines = plan.splitlines()
            depth = lambda x: len(x) - len(x.lstrip(" +-:*(0123456789)"))
            for k, line in enumerate(lines):
                if "FileScan" in line and store.papers in line:
                    above, at = [], depth(line)
                    for up in reversed(lines[:k]):
                        if depth(up) < at:
                            above.append(up)
                            at = depth(up)
                            if "Join" in up:
                                break
                    assert above and not any("Exchange" in up for up in above), plan
            assert "Bucketed: true" in plan
        assert K.by_doi(refs.select("ref_id", "doi"), store).count() == 130
        asked = spark.createDataFrame([(1_000_000,), (5,), (5,), (-3,), (None,)], "asked long")
        assert sorted(r.p_paper_id for r in K.by_id(asked, store, "asked").collect()) == [5, 5, 1_000_000]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.drop(spark)


def test_running_sums_are_those_of_the_loop(spark):
    draw = random.Random(3)
    rows = [(k, draw.choice(["a", "b", None]), draw.choice([None, draw.randint(0, 9) / 4])) for k in range(700)]
    draw.shuffle(rows)
    got = U.running(spark.createDataFrame(rows, "k long, g string, v double").repartition(3), ["k"], {"total": F.col("v"), "n": F.lit(1)}, ("g",)).collect()
    total, n = {}, {}
    for k, g, v in sorted(rows):
        total[g], n[g] = total.get(g, 0) + (v or 0), n.get(g, 0) + 1
        r = next(r for r in got if r.k == k)
        assert (r.total, r.n) == (pytest.approx(total[g]), n[g])
    assert len(got) == 700 and U.running(spark.createDataFrame([], "k long, v double"), ["k"], {"t": F.col("v")}).count() == 0


def test_statistics_are_observed_on_the_way(spark):
    asked = spark.createDataFrame([(1, "m", 2.0, "q"), (2, "m", None, "q"), (3, None, 4.0, "p"), (4, "m", 1.0, None), (5, "m", 1.0, None)], "k long, model string, seconds double, q string")
    rows, seen = U.observed(U.first_asked(asked, ["q"], ["k"]))
    got = U.model_statistics(rows, ["k"]).orderBy("k").collect()
    assert [r.reused for r in got] == [False, True, False, False, True]
    assert [(r.n_requests, r.n_successes, round(r.mean_seconds, 6), r.n_model) for r in got] == [(1, 1, 2.0, 1), (2, 1, 2.0, 1), (3, 2, 3.0, 1), (4, 3, round(7 / 3, 6), 2), (5, 4, 2.0, 3)]
    assert [r.reuse_rate for r in got] == pytest.approx([0, 1 / 2, 1 / 3, 1 / 4, 2 / 5])
    assert seen.get == {"n": 5, "successes": 4, "seconds": 8.0, "reused": 2}
