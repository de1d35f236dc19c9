"""Text functions as column expressions; Arrow UDFs only where no built-in exists."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: DOI prefixes, and publishers by domain, in order.
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:"]
PUBLISHER_DOMAINS = [
    ("springer.com", "Springer"),
    ("ieeexplore.ieee.org", "IEEE"),
    ("acm.org", "ACM"),
    ("nature.com", "Nature Publishing Group"),
    ("science.org", "Science/AAAS"),
    ("wiley.com", "Wiley"),
    ("elsevier.com", "Elsevier"),
    ("pubmed.ncbi.nlm.nih.gov", "PubMed/NIH"),
    ("arxiv.org", "arXiv"),
    ("eprint.iacr.org", "IACR"),
]


#: White space of all of Unicode, in a form that every engine's expressions share.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def tokens(c: Column) -> Column:
    """Words of a text, split at white space."""
    return F.filter(F.split(F.trim(F.lower(c)), f"{SPACE}+"), lambda w: w != "")


def distinct_words(c: Column) -> Column:
    """Distinct runs of letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; 1 if neither has one."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def cosine_terms(a: Column, b: Column) -> Column:
    """Cosine of word counts, within the row."""
    x, y = tokens(a), tokens(b)
    count = lambda words, w: F.size(F.filter(words, lambda v: v == w)).cast("double")
    dot = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, w: s + count(x, w) * count(y, w))
    norm = lambda words: F.sqrt(F.aggregate(F.array_distinct(words), F.lit(0.0), lambda s, w: s + count(words, w) * count(words, w)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(dot / (norm(x) * norm(y)))


def _plain(s: str, keep_hyphens: bool = True) -> str:
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if unicodedata.category(c)[0] != "C")
    s = " ".join(s.split())
    for dash in "\u2212\u2013\u2014":
        s = s.replace(dash, "-")
    return (s if keep_hyphens else s.replace("-", "")).strip()


@F.pandas_udf(StringType())
def _normalised(s: pd.Series) -> pd.Series:
    return s.map(lambda t: _plain(t) if isinstance(t, str) else None).astype(object)


def normalise_text(c: Column) -> Column:
    """NFKD, no control characters, single spaces, one kind of dash. Printable ASCII stays in the JVM: Python sees a null for it."""
    plain = c.rlike(r"^[\x20-\x7E]*$")
    return F.when(plain, F.trim(F.regexp_replace(c, " +", " "))).otherwise(_normalised(F.when(~plain, c)))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    matcher, known = difflib.SequenceMatcher(None), {}
    for x, y in sorted({(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None}, key=lambda p: p[1]):
        matcher.set_seq1(x)  # texts on the right are taken apart once
        if matcher.b is not y:
            matcher.set_seq2(y)
        known[x, y] = matcher.ratio()
    return pd.Series([known.get(pair, 0.0) for pair in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column, above: Column | float = 0.0) -> Column:
    """Ratio of matched characters; not symmetric: the reference's text first. 0 where it can't be more than `above`.

    Python sees nulls for equal and empty texts and for those whose lengths keep the ratio down.
    """
    n, m = F.char_length(a), F.char_length(b)
    need = present(a) & present(b) & (a != b) & (2 * F.least(n, m) / (n + m) > above)
    return F.when(~present(a) | ~present(b), 0.0).when(a == b, 1.0).when(need, _ratio(F.when(need, a), F.when(need, b))).otherwise(0.0)


def with_similarity(rows: DataFrame, name: str, a: str, b: str, method: str = "sequence") -> DataFrame:
    """rows + name: the likeness of two columns in their normal forms, by jaccard, cosine, or any other name: by sequence.

    The forms are columns first: what compares words looks at each many times.
    """
    by = {"jaccard": token_jaccard, "cosine": cosine_terms}.get(method, sequence_ratio)
    formed = rows.withColumns({"__a__": F.lower(normalise_text(F.col(a))), "__b__": F.lower(normalise_text(F.col(b)))})
    x, y = F.col("__a__"), F.col("__b__")
    both = present(F.col(a)) & present(F.col(b))
    return formed.withColumn(name, F.when(~both, 0.0).when(x == y, 1.0).otherwise(by(x, y))).drop("__a__", "__b__")


def year_in(c: Column) -> Column:
    """First year from 1950 to 2049 in a text."""
    return F.regexp_extract(c, r"\b(19[5-9][0-9]|20[0-4][0-9])\b", 1).try_cast("int")


def valid_year(y: Column) -> Column:
    return F.coalesce(y.between(1950, 2030), F.lit(False))


def doi_in(c: Column) -> Column:
    """DOI after `doi:` or a resolver's address, up to white space; empty if none."""
    return F.regexp_extract(c, r"(?i)(?:doi:[ ]*|doi\.org/)(10\.[0-9]+/[^ \t\r\n]+)", 1)


def normalise_doi(c: Column) -> Column:
    """DOI without its prefixes, in lower case; empty unless it is 10.<digits>/<rest>."""
    out = F.trim(c)
    for prefix in DOI_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    out = F.lower(F.trim(out))
    return F.when(out.rlike(r"^10\.[0-9]+/.+"), out).otherwise("")


def publisher_of(url: Column) -> Column:
    out = F.lit("Unknown Publisher")
    for domain, name in reversed(PUBLISHER_DOMAINS):
        out = F.when(F.lower(url).contains(domain), name).otherwise(out)
    return F.when(present(url), out).otherwise("Unknown")


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix))).otherwise(c)


def without_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")


#: LaTeX's fonts, mathematics and commands, and what stays of them, in order.
LATEX = [
    (r"\$\\textnormal\{\\textsc\{([^}]*)\}\}\$", "$1"),
    (r"\$\\textnormal\\textsc\{([^}]*)\}\$", "$1"),
    (r"\$\\textsc\{([^}]*)\}\$", "$1"),
    (r"\$\\textnormal\{([^}]*)\}\$", "$1"),
    (r"\$\\[a-zA-Z]+\{([^}]*)\}\$", "$1"),
    (r"\$\\[a-zA-Z]+([^$]*)\$", "$1"),
    (r"\$([^$]*)\$", "$1"),
    (r"\\[a-zA-Z]+\{([^}]*)\}", "$1"),
    (r"\\[a-zA-Z]+", ""),
    (f"{SPACE}+", " "),
]
#: What is told apart in titles only by habit, in order.
TITLE_RULES = [
    (r" *\+ *", "+"),
    (r" *\* *", "*"),
    (r" *# *", "#"),
    (r" *: *", ": "),
    (r"\bpost-quantum\b", "post quantum"),
    (r"\bpost quantum\b", "postquantum"),
    (r"^the +", ""),
    (r"[.,:;!?]+$", ""),
]


def strip_latex(c: Column) -> Column:
    """Fonts, mathematics and commands of LaTeX, in order; what they enclose stays."""
    for pattern, to in LATEX:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def _title_key(plain: Column) -> Column:
    for pattern, to in TITLE_RULES:
        plain = F.regexp_replace(plain, pattern, to)
    return F.trim(plain)


def title_plain(c: Column) -> Column:
    """Standard form of a title for comparison."""
    return F.lower(normalise_text(strip_latex(c)))


def title_key(c: Column) -> Column:
    """Aggressive form of a title for comparison."""
    return _title_key(title_plain(c))


@F.pandas_udf(DoubleType())
def _title_score(a: pd.Series, b: pd.Series, key_a: pd.Series, key_b: pd.Series) -> pd.Series:
    def best(x: str, y: str, kx: str, ky: str) -> float:
        if x == y or (kx and kx == ky):
            return 1.0
        p, q = set(kx.split()), set(ky.split())
        top = len(p & q) / len(p | q) if p and q else 0.0
        for v, w in dict.fromkeys(((x, y), (kx, ky))):
            if v and w and 2 * min(len(v), len(w)) > top * (len(v) + len(w)):
                top = max(top, difflib.SequenceMatcher(None, v, w).ratio())
        return top

    rows = zip(a, b, key_a, key_b, strict=True)
    return pd.Series([best(*row) if row[0] and row[1] else 0.0 for row in rows], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    """Best of three: sequence ratio of the plain forms, of the aggressive forms, and word Jaccard of the latter.

    Equal titles with a letter or digit are told in the JVM; Python sees nulls for them. Ratios are sought only where lengths
    allow more than the Jaccard.
    """
    settled = (a == b) & a.rlike(r"[\p{L}\p{N}]") & ~F.contains(a, F.lit("\\"))
    need = present(a) & present(b) & ~settled
    x, y = title_plain(F.when(need, a)), title_plain(F.when(need, b))
    return F.when(~present(a) | ~present(b), 0.0).when(settled, 1.0).otherwise(_title_score(x, y, _title_key(x), _title_key(y)))


def search_key(title: Column, first_author: Column, year: Column) -> Column:
    """Key under which equal searches are one."""
    return F.concat_ws("|", F.lower(F.trim(title)), F.lower(F.trim(first_author)), year.cast("string"))


#: Words that are no key terms.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "via", "using", "based", "new"]


def key_terms(c: Column, most: int = 8) -> Column:
    """First distinct words of three letters or more that aren't stop words."""
    found = F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{3,}$")))
    return F.slice(F.array_except(found, F.array(*map(F.lit, STOP_WORDS))), 1, most)
