r"""Chat formatting in Spark expressions: sorted turn structs, same-role neighbours merged, one string a conversation.

Template, fixed values: a turn opens with "### <Role>: ", texts of one turn are parted by " <part> ", a turn ends with
" </turn>\n". Inside texts and roles a backslash doubles and "<" and "#" get one before them, so no control string stands
there unescaped, whatever the text says; removing one backslash of each escape gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD, COLON, PART, END = "### ", ": ", " <part> ", " </turn>\n"
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
MARKED = "assistant"
BLOCK = 256  # pieces summed at once


def escape(text: Column) -> Column:
    r"""Reversible: \ < # : get a backslash before them."""
    return F.regexp_replace(text, r"([\\<#:])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def shown(role: Column) -> Column:
    """User, Assistant, System for the three usual roles; others are escaped as they are, after a '='."""
    out = F.concat(F.lit("="), escape(role))
    for name, title in ROLES.items():
        out = F.when(role == name, F.lit(title)).otherwise(out)
    return out


def _sums(lengths: Column) -> Column:
    """0 and the sums of the first 1, 2, ... of the lengths."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def chat_format(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """rows by turn -> one row per conversation: conv, formatted, loss_spans array<struct<start,length>>.

    Null texts and roles are empty, null turns sort first, equal turns by role and text; repeated rows stay.
    Null conversation ids form one conversation. Other columns are ignored. Spans count characters from 0 and cover
    the escaped assistant texts only: parts, heads and ends are outside the loss. A conversation is one group,
    as long as its own turns.
    """
    turns = rows.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("one"),
    )
    got = turns.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    # merge: a run of one role goes from its first turn to the next run's first one
    begins = F.transform("turns", lambda x, k: F.when((k == 0) | (F.get("turns", k - 1)["role"] != x["role"]), k))
    runs = got.select("conv", "turns", F.array_compact(begins).alias("begins"))
    ends = F.concat(F.slice("begins", 2, F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.size("turns")))
    merge = F.zip_with(
        "begins", ends, lambda b, e: F.struct(F.get("turns", b)["role"].alias("role"), F.transform(F.slice("turns", b + 1, e - b), lambda x: escape(x["text"])).alias("texts"))
    )
    merged = runs.select("conv", merge.alias("merged"))
    # each merged turn as its pieces: the strings in order and whether the loss counts them
    pieces = F.flatten(
        F.transform(
            "merged",
            lambda m: F.concat(
                F.array(F.struct(F.concat(F.lit(HEAD), shown(m["role"]), F.lit(COLON)).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda t, i: F.concat(
                            F.when(i > 0, F.array(F.struct(F.lit(PART).alias("s"), F.lit(False).alias("loss")))).otherwise(F.array().cast("array<struct<s:string,loss:boolean>>")),
                            F.array(F.struct(t.alias("s"), (m["role"] == MARKED).alias("loss"))),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    cut = merged.select("conv", pieces.alias("pieces"))
    # spans: sums of lengths block by block, then within each block, so no long array is copied at every piece
    width = lambda p: F.char_length(p["s"]).cast("long")
    begin = F.transform(F.sequence(F.lit(0), F.size("pieces") - 1, F.lit(BLOCK)), lambda k: F.slice("pieces", k + 1, F.lit(BLOCK)))
    blocks = cut.withColumn("blocks", begin).withColumn("at", _sums(F.transform("blocks", lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, p: n + width(p)))))

    def located(block: Column, at: Column) -> Column:
        starts = F.slice(_sums(F.transform(block, width)), F.lit(1), F.size(block))
        rows = F.zip_with(block, starts, lambda p, s: F.struct(p["loss"].alias("loss"), F.struct((at + s).alias("start"), width(p).alias("length")).alias("span")))
        return F.transform(F.filter(rows, lambda r: r["loss"]), lambda r: r["span"])

    spans = F.flatten(F.zip_with("blocks", F.slice("at", F.lit(1), F.size("blocks")), located))
    cut = blocks
    return cut.select(F.col("conv").alias(conv), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def chat_parse(formatted: Column) -> Column:
    """The turns read back: array<struct<role,text>>, one for each input row."""
    blocks = F.filter(F.split(formatted, r" </turn>\n", -1), lambda b: b.startswith(HEAD))
    plain = {title: name for name, title in ROLES.items()}

    def role(block: Column) -> Column:
        said = F.regexp_extract(block, r"(?s)^### ((?:[^\\:]|\\.)*): ", 1)
        out = unescape(F.substring(said, 2, 1 << 30))
        for title, name in plain.items():
            out = F.when(said == title, F.lit(name)).otherwise(out)
        return out

    body = lambda b: F.regexp_replace(b, r"(?s)\A### (?:[^\\:]|\\.)*: ", "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), " <part> ", -1), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations of the table and of conversation -7."""
    own = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    out = chat_format(rows)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    back = out.select("conv_id", chat_parse(F.col("formatted")).alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESC = "length(t) + length(regexp_replace(t, '[^\\\\<#:]', '', 'g'))"
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
near AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY turn, r, t) IS NOT DISTINCT FROM r AS joins FROM rows),
sized AS (SELECT *, {_ESC} + CASE WHEN joins THEN {len(PART)} ELSE {len(HEAD + COLON + END)} + CASE r WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6
  ELSE 1 + length(r) + length(regexp_replace(r, '[^\\\\<#:]', '', 'g')) END END AS n FROM near)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
