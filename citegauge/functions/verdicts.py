"""Verdicts of language models: the prompt about a reference, the key of equal questions, and the reading of an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import let

#: What an answer without JSON says for, against and strongly against a reference; words of its lists.
AUTHENTIC = [
    r"\bis[_\s]*authentic[_\s]*[:=]\s*true",
    r"authentic[_\s]*[:=]\s*yes",
    r"appears?\s+(?:to\s+be\s+)?(?:legitimate|authentic|genuine|valid)",
    r"likely\s+(?:authentic|legitimate|genuine)",
    r"evidence\s+supports?\s+authenticity",
    r"no\s+(?:significant|major|substantial)\s+red\s+flags?",
    r"consistent\s+with\s+(?:legitimate|authentic)\s+(?:academic\s+)?(?:publication|reference)",
]
SUSPICIOUS = [
    r"\bis[_\s]*authentic[_\s]*[:=]\s*false",
    r"authentic[_\s]*[:=]\s*no",
    r"appears?\s+(?:to\s+be\s+)?(?:suspicious|questionable|doubtful|concerning)",
    r"(?:significant|substantial|major)\s+(?:concerns?|red\s+flags?|inconsistencies)",
    r"(?:likely|probably|appears)\s+(?:fabricated|fake|suspicious)",
    r"evidence\s+(?:suggests?|indicates?)\s+(?:manipulation|fabrication)",
]
FAKE = [
    r"(?:clearly|obviously|definitely)\s+(?:fabricated|fake|fraudulent)",
    r"(?:impossible|cannot\s+be)\s+(?:authentic|legitimate|real)",
    r"(?:strong|compelling)\s+evidence\s+of\s+(?:fabrication|fraud|manipulation)",
    r"multiple\s+(?:major|critical)\s+red\s+flags?",
]
CONFIDENCE = r"confidence[_\s]*[:=]\s*([0-9]*\.?[0-9]+)"
RED_WORDS = ["red flag", "concern", "suspicious", "inconsistency"]
GOOD_WORDS = ["positive", "support", "authentic", "legitimate", "consistent"]
REASON_WORDS = ["reasoning", "analysis", "assessment", "evaluation"]
BULLET = r"^[*\-•0-9+.]\s*"
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BRACED = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def _hits(text: Column, patterns: list[str]) -> Column:
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def _listed(text: Column, words: list[str]) -> Column:
    """The first five bullets that hold one of the words, of more than ten characters, cut at 150."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(BULLET) & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(x), w)))
    items = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, BULLET, "")), lambda x: F.char_length(x) > 10)
    return F.slice(F.transform(items, lambda x: F.substring(x, 1, 150)), 1, 5)


def _reasoning(text: Column) -> Column:
    """Lines under a heading of reasoning until a blank one, bullets left out, cut at 1000; else the text, cut at 500."""
    kind = "struct<on:boolean,said:array<string>>"

    def line(s: Column, raw: Column) -> Column:
        x = F.trim(raw)
        opens = F.exists(F.array(*map(F.lit, REASON_WORDS)), lambda w: F.contains(F.lower(raw), w))
        head = F.when(F.contains(raw, F.lit(":")), F.array(F.trim(F.regexp_extract(raw, "(?s)^[^:]*:(.*)$", 1)))).otherwise(F.array())
        more = F.when(s["on"] & (x != "") & ~x.rlike("^[*•-]"), F.array(x)).otherwise(F.array())
        return F.struct(F.when(opens, True).when(s["on"] & (x == ""), False).otherwise(s["on"]).alias("on"), F.concat(s["said"], F.when(opens, head).otherwise(more)).alias("said")).cast(kind)

    said = F.aggregate(F.split(text, "\n"), F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("said")).cast(kind), line, lambda s: s["said"])
    whole = F.when(F.char_length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text)
    return F.when(F.size(said) > 0, F.substring(F.array_join(said, " "), 1, 1000)).otherwise(whole)


def _from_text(text: Column) -> Column:
    low = F.lower(text)
    yes, doubt, fake = _hits(low, AUTHENTIC), _hits(low, SUSPICIOUS), _hits(low, FAKE)
    n = F.regexp_extract(low, CONFIDENCE, 1).try_cast("double")
    stated = F.when(n.between(0, 1), n).when(n.between(0, 100), n / 100).otherwise(0.5)
    good = (yes > fake + doubt) & (yes >= 2)
    conf = (
        F.when(good, F.least(F.lit(0.9), stated + 0.1 * yes))
        .when((fake > yes) & (fake >= 1), F.least(F.lit(0.9), stated + 0.1 * fake))
        .when(doubt > yes, F.greatest(F.lit(0.3), stated - 0.05 * doubt))
        .otherwise(0.4)
    )
    return F.struct(good.alias("authentic"), conf.alias("ai_confidence"), _reasoning(text).alias("reasoning"), _listed(text, RED_WORDS).alias("red"), _listed(text, GOOD_WORDS).alias("good"))


def _from_json(v: Column) -> Column:
    """Missing fields take defaults; lists keep texts of over five characters among their first ten, cut at 200."""
    get = lambda path, kind, other: F.coalesce(F.try_variant_get(v, path, kind), F.lit(other))
    items = lambda path: F.coalesce(F.transform(F.filter(F.transform(F.slice(F.try_variant_get(v, path, "array<string>"), 1, 10), lambda x: F.trim(x)), lambda x: F.char_length(x) > 5), lambda x: F.substring(x, 1, 200)), F.array().cast("array<string>"))
    return F.struct(
        get("$.is_authentic", "boolean", False).alias("authentic"), get("$.confidence", "double", 0.5).alias("ai_confidence"), get("$.reasoning", "string", "").alias("reasoning"),
        items("$.red_flags").alias("red"), items("$.positive_indicators").alias("good"),
    )


def parse_verdict(raw: Column) -> Column:
    """struct (authentic, ai_confidence, reasoning, red, good) of an answer; null for null.

    JSON as it stands, else in a fenced block, else within braces; an answer without any is read by patterns.
    """
    found = F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, FENCED, 1)), F.try_parse_json(F.regexp_extract(raw, BRACED, 0)))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), F.lit(False))
    return F.when(raw.isNotNull(), F.when(is_object, let(found, _from_json)).otherwise(_from_text(raw)))


def question_key(title: Column, authors: Column, venue: Column, year: Column, n_found: Column, model: str, independent: bool = True) -> Column:
    """Digest under which equal questions to a model are one."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", none(title), F.array_join(F.coalesce(authors, F.array()), ","), none(venue), none(year), F.lit(str(independent)), F.lit(model), none(n_found)))


def prompt(title: Column, authors: Column, venue: Column, year: Column, raw: Column, candidates: Column | None = None) -> Column:
    """The question to a model about a reference; with candidates, an array of texts, their evidence goes along."""
    none = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("not given"))
    parts = [
        F.lit("Judge whether this bibliographic reference names a real publication."), F.concat(F.lit("Title: "), none(title)), F.concat(F.lit("Authors: "), none(F.array_join(F.coalesce(authors, F.array()), ", "))),
        F.concat(F.lit("Venue: "), none(venue)), F.concat(F.lit("Year: "), none(year)), F.concat(F.lit("As printed: "), none(raw)),
    ]
    if candidates is not None:
        parts.append(F.concat(F.lit("Catalogues hold:\n- "), F.array_join(candidates, "\n- ")))
    parts.append(F.lit("Answer in JSON: is_authentic (true or false), confidence (0 to 1), reasoning, red_flags (list), positive_indicators (list)."))
    return F.concat_ws("\n", *parts)
