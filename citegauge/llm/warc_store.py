"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins.

A response record's block is an HTTP response: its own head, kept with the record's header, and the payload. A revisit's
block is that head alone. Headers and heads are kept byte for byte; only payloads are shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, table, written

EOL = "\r\n"
#: When pages were captured, where the caller doesn't say.
CAPTURED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex40: Column) -> Column:
    """RFC 4648 base32, upper case, of a SHA-1 given as 40 hexadecimal digits: 40 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_urn(*parts: Column) -> Column:
    """A record id, a hash of the parts that tell a record from all others."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """`name: value` lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit("")) for name, value in fields], F.lit(EOL))


def archive(pages: DataFrame, least_revisit: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", captured: str = CAPTURED) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written to the shared folder.

    payloads (digest, payload, bytes, sha1, many, page, target): one row per distinct payload, digest its SHA-256. headers
    (digest, record_id, header, head): one row per page, the record's header and the head of its block, exact. Groups of any
    size of equal payloads or equal rows shrink to a row per task before the shuffle, and payloads of very many pages reach
    their headers by broadcast, without their bytes. Null html is the empty payload, null url an empty target; null page ids
    are written as empty; CR and LF in urls are percent-encoded. Repeated rows are records of their own, with ids of their own.
    Among payloads of at least `least_revisit` bytes the largest page_id of a digest is the response (all of its rows, if
    repeated) and others revisit it; shorter payloads are responses all. Other columns are ignored; `captured` is the date of all.
    """
    target = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(page_id).alias("page"), target.alias("target"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = F.max(F.struct("page", "target")).alias("first")
    once = rows.groupBy("digest").agg(first, F.count("*").alias("many"), F.first("payload").alias("payload"))
    once = once.select("digest", "payload", F.octet_length("payload").alias("bytes"), base32(F.sha1("payload")).alias("sha1"), "many", F.col("first.page").alias("of_page"), F.col("first.target").alias("of_target"))
    payloads = written(once, "warc-payloads")
    total = payloads.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    same = rows.groupBy("page", "target", "digest").agg(F.count("*").alias("n"))
    joined = spread_join(same, payloads.drop("payload"), ["digest"], "many", total).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    revisit = (F.col("bytes") >= least_revisit) & ~F.col("page").eqNullSafe(F.col("of_page"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes"))))
    own = record_urn(F.col("page"), F.col("target"), F.col("digest"), F.col("k"))
    of = record_urn(F.col("of_page"), F.col("of_target"), F.col("digest"), F.lit(1))
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _lines(
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", own),
            ("WARC-Date", F.lit(captured)),
            ("WARC-Target-URI", F.col("target")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Refers-To", F.when(revisit, of)),
            ("WARC-Refers-To-Page", F.when(revisit, F.col("of_page"))),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            ("WARC-Page", F.coalesce(F.col("page").cast("string"), F.lit(""))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
            ("Content-Length", F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
        ),
    )
    headers = joined.select("digest", revisit.alias("revisit"), header.alias("header"), head.alias("head"))
    return written(headers, "warc-headers"), payloads


def field(header: Column, name: str) -> Column:
    """The value of a header field, null if it is absent."""
    got = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{EOL}{name}: ")), got)


def verified(payloads: DataFrame) -> DataFrame:
    """Payloads whose stored bytes still have their digest; others raise."""
    ok = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("stored payload differs from its digest"))
    return payloads.where(ok.isNull())


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record): each original record rebuilt, in bytes; only responses are joined with their payload."""
    end = F.lit((EOL + EOL).encode())
    made = lambda block: F.concat(F.encode("header", "UTF-8"), F.encode("head", "UTF-8"), block, end).alias("record")
    full = headers.where("not revisit").join(verified(payloads.select("digest", "payload")), "digest")
    return full.select(made(F.col("payload"))).union(headers.where("revisit").select(made(F.lit(b""))))


def parsed(records: DataFrame) -> DataFrame:
    """(header, payload_bytes, payload_digest) read back from record bytes; raises where a length differs from the header's."""
    text = F.decode("record", "ISO-8859-1")  # a character per byte
    got = records.select(text.alias("t")).withColumn("at", F.instr("t", EOL + EOL) + 3)
    block = F.substring("t", F.col("at") + 1, F.char_length("t") - F.col("at") - 4)
    got = got.select(F.decode(F.encode(F.substring("t", F.lit(1), F.col("at")), "ISO-8859-1"), "UTF-8").alias("header"), block.alias("block"))
    right = F.assert_true(field(F.col("header"), "Content-Length").cast("long") == F.char_length("block"), F.lit("block differs from its Content-Length"))
    got = got.where(right.isNull())
    payload = F.encode(F.substring("block", F.instr("block", EOL + EOL) + 4, F.char_length("block")), "ISO-8859-1")
    return got.select("header", payload.alias("payload")).select("header", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))


def op7_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is read from the rebuilt records: a revisit's payload is that of the record it refers to."""
    headers, payloads = archive(table(spark, sf_dir, "pages"))
    h = F.col("header")
    page, kind = field(h, "WARC-Page").cast("long").alias("page_id"), field(h, "WARC-Type").alias("record_type")
    back = parsed(records(headers, payloads)).select(page, kind, field(h, "WARC-Record-ID").alias("id"), field(h, "WARC-Refers-To").alias("of"), field(h, "WARC-Refers-To-Page").cast("long").alias("refers_to"), "payload_bytes", "payload_digest")
    back = written(back, "warc-read")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    response, revisit = back.where("record_type = 'response'"), back.where("record_type = 'revisit'")
    often = revisit.groupBy("of").agg(F.count("*").alias("many"))
    whole = response.select(F.col("id").alias("of"), "payload_bytes", "payload_digest").join(often, "of")
    return response.select(*names).union(spread_join(revisit.drop("payload_bytes", "payload_digest"), whole, ["of"], "many", back.count()).select(*names))


_DIGITS = " || ".join(f"to_base(CAST('0x' || substr(h, {1 + 10 * k}, 10) AS BIGINT), 32, 8)" for k in range(4))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
s AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
  translate({_DIGITS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM s
"""
