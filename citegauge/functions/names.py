"""Author, venue and year functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present, sequence_ratio, token_jaccard

#: Particles of surnames; spellings of names; venues by alias; tiers by keyword; credibility of sources.
PARTICLES = ["van", "von", "de", "del", "della", "di", "da", "dos", "das", "le", "la", "el", "al"]
VARIANTS = {
    "hosein": ["hossein", "hussein", "hussain", "husain", "husein"],
    "hossein": ["hosein", "hussein", "hussain", "husain", "husein"],
    "hussein": ["hosein", "hossein", "hussain", "husain", "husein"],
    "mohammad": ["mohamed", "muhammad", "mohammed", "muhammed", "mohamad"],
    "mohamed": ["mohammad", "muhammad", "mohammed", "muhammed", "mohamad"],
    "muhammad": ["mohammad", "mohamed", "mohammed", "muhammed", "mohamad"],
    "ali": ["aly"],
    "ahmad": ["ahmed", "ahmet"],
    "ahmed": ["ahmad", "ahmet"],
    "hassan": ["hasan"],
    "hasan": ["hassan"],
    "reza": ["rida", "ridha"],
    "amir": ["ameer"],
    "jose": ["josé"],
    "josé": ["jose"],
    "muller": ["müller", "mueller"],
    "müller": ["muller", "mueller"],
    "mueller": ["muller", "müller"],
    "bjorn": ["björn"],
    "björn": ["bjorn"],
    "jorg": ["jörg", "joerg"],
    "jörg": ["jorg", "joerg"],
    "joerg": ["jorg", "jörg"],
    "andras": ["andrás"],
    "andrás": ["andras"],
    "francois": ["françois"],
    "françois": ["francois"],
    "xiao": ["hsiao", "shiao"],
    "zhang": ["chang"],
    "wang": ["wong"],
    "chen": ["chan"],
    "liu": ["lau", "liew"],
    "li": ["lee", "ly"],
    "zhou": ["chou", "chow"],
    "wu": ["woo", "ng"],
    "huang": ["wong", "hwang"],
    "yang": ["yeung"],
    "alexander": ["aleksandr", "alexsandr"],
    "aleksandr": ["alexander", "alexsandr"],
    "dmitri": ["dmitry", "dmitrii"],
    "dmitry": ["dmitri", "dmitrii"],
    "sergei": ["sergey", "serguei"],
    "sergey": ["sergei", "serguei"],
    "andrei": ["andrey", "andre"],
    "andrey": ["andrei", "andre"],
    "yuri": ["yury", "yurii"],
    "michael": ["mikhail", "michel"],
    "john": ["johann", "jean", "jan", "juan", "giovanni", "joao"],
    "peter": ["pierre", "pedro", "pietro", "piotr", "petr"],
    "william": ["wilhelm", "guillaume", "guillermo"],
    "james": ["jacob", "jacques", "jaime", "giacomo"],
    "george": ["georg", "georges", "jorge", "giorgio"],
    "paul": ["pablo", "paolo", "pavel"],
    "thomas": ["tomas", "tommaso"],
    "daniel": ["daniele", "danilo"],
    "david": ["davide"],
    "robert": ["roberto"],
    "christopher": ["christoph", "cristopher", "kristopher"],
}
VENUES = [
    ("crypto", ["advances in cryptology", "crypto", "annual international cryptology conference"]),
    ("eurocrypt", ["advances in cryptology - eurocrypt", "eurocrypt", "annual eurocrypt conference"]),
    ("asiacrypt", ["advances in cryptology - asiacrypt", "asiacrypt", "annual asiacrypt conference"]),
    ("fse", ["fast software encryption", "fse"]),
    ("ches", ["cryptographic hardware and embedded systems", "ches"]),
    ("pkc", ["public key cryptography", "pkc"]),
    ("tcc", ["theory of cryptography", "tcc", "theory of cryptography conference"]),
    ("sp", ["ieee symposium on security and privacy", "oakland", "s&p", "ieee s&p"]),
    ("ccs", ["acm conference on computer and communications security", "acm ccs"]),
    ("usenix security", ["usenix security symposium", "usenix security"]),
    ("ndss", ["network and distributed system security", "ndss symposium"]),
    ("neurips", ["advances in neural information processing systems", "neurips", "nips"]),
    ("icml", ["international conference on machine learning", "icml"]),
    ("iclr", ["international conference on learning representations", "iclr"]),
    ("aaai", ["aaai conference on artificial intelligence", "aaai"]),
    ("ijcai", ["international joint conference on artificial intelligence", "ijcai"]),
    ("cvpr", ["ieee conference on computer vision and pattern recognition", "cvpr"]),
    ("iccv", ["ieee international conference on computer vision", "iccv"]),
    ("eccv", ["european conference on computer vision", "eccv"]),
    ("acl", ["annual meeting of the association for computational linguistics", "acl"]),
    ("emnlp", ["conference on empirical methods in natural language processing", "emnlp"]),
    ("naacl", ["north american chapter of the association for computational linguistics", "naacl"]),
    ("sigmod", ["acm sigmod", "sigmod"]),
    ("vldb", ["very large data bases", "vldb", "pvldb"]),
    ("osdi", ["usenix symposium on operating systems design and implementation", "osdi"]),
    ("sosp", ["acm symposium on operating systems principles", "sosp"]),
    ("stoc", ["symposium on theory of computing", "stoc"]),
    ("focs", ["ieee symposium on foundations of computer science", "focs"]),
    ("jacm", ["journal of the acm", "jacm"]),
    ("cacm", ["communications of the acm", "cacm"]),
    ("joc", ["journal of cryptology", "joc"]),
    ("tocs", ["acm transactions on computer systems", "tocs"]),
    ("tosc", ["iacr transactions on symmetric cryptology", "tosc"]),
    ("tches", ["iacr transactions on cryptographic hardware and embedded systems", "tches"]),
    ("arxiv", ["arxiv", "arxiv preprint", "arxiv.org"]),
    ("iacr eprint", ["iacr eprint", "cryptology eprint archive", "eprint", "iacr cryptology eprint"]),
]
#: Words that say nothing of a venue, and what goes from its name, in order: pattern and replacement.
VENUE_STOP = ["the", "of", "on", "in", "for", "and", "a", "an", "at", "to", "annual", "international", "conference", "symposium", "workshop"]
VENUE_RULES = [
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"[(\-,\s]*[0-9]{4}[)\s]*$", ""),
    (r"\s+[0-9]{4}\s+", " "),
    (r"^proceedings of (the\s+)?", ""),
    (r"\s+proceedings$", ""),
    (r"^[0-9]+(st|nd|rd|th)\s+", ""),
    (r"\s+[0-9]+(st|nd|rd|th)\s+", " "),
    (r"lecture notes in computer science.*", ""),
    (r"lncs\s*[0-9]+", ""),
    (r"volume\s*[0-9]+", ""),
    (r"\s+vol\.\s*[0-9]+", ""),
    (r"\s+pp\.\s*[0-9]+[-–][0-9]+", ""),
    (r"[^\p{L}\p{N}_\s&-]", ""),
    (r"^\s+|\s+$", ""),
]
TIERS = [
    ("preprints", ["arxiv", "biorxiv", "medrxiv", "iacr eprint", "cryptology eprint", "eprint archive", "ssrn", "preprint"]),
    ("tier1_journals", ["nature", "science", "cell", "lancet", "nejm", "new england journal", "journal of cryptology", "ieee transactions", "acm transactions", "journal of the acm", "siam journal"]),
    ("tier1_conferences", ["crypto", "eurocrypt", "asiacrypt", "neurips", "icml", "cvpr", "iccv", "stoc", "focs", "sp", "oakland", "usenix security", "ccs", "ndss", "sigmod", "vldb", "osdi", "sosp", "pldi", "popl"]),
    ("tier2_conferences", ["fse", "ches", "pkc", "tcc", "aaai", "ijcai", "eccv", "iclr", "acl", "emnlp", "naacl", "www", "kdd", "icde", "wsdm"]),
    ("workshops", ["workshop", "symposium", "colloquium"]),
]
CREDIBILITY = {"dblp": 0.95, "pubmed": 0.95, "crossref": 0.90, "semantic_scholar": 0.85, "openalex": 0.85, "arxiv": 0.80, "iacr": 0.90, "ieee": 0.90, "acm": 0.90, "springer": 0.85, "google_scholar": 0.65, "unknown": 0.50}
DEFAULT_CREDIBILITY = 0.5
AUTHORITATIVE_FROM = 0.85


def _unaccented() -> tuple[str, str]:
    """Letters of one base letter and marks, and those bases; Latin, Greek, Cyrillic."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))) for k in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def without_marks(c: Column) -> Column:
    """Letters without their diacritics, in the JVM."""
    return F.regexp_replace(F.translate(c, *_unaccented()), r"\p{Mn}", "")


def strip_number(c: Column) -> Column:
    """A name without the number that tells namesakes apart."""
    for pattern in (r"[ ]+[0-9]{4}$", r"[ ]*\([0-9]+\)$", r"[ ]*\[[0-9]+\]$"):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(c)


def clean_name(c: Column) -> Column:
    """No number, honorific or suffix; 'Last, First' is turned; lower case without marks, dots and hyphens."""
    n = F.lower(F.trim(c))
    for pattern in (r"\s+[0-9]{4}$", r"\s+\([0-9]+\)$", r"\s+\[[0-9]+\]$", r"\b(dr|prof|professor|mr|mrs|ms|sir|dame)\.\s*", r"\s+(jr|sr|ii|iii|iv|phd|md|esq)\.?$"):
        n = F.regexp_replace(n, pattern, "")
    n = F.when(n.contains(","), F.concat_ws(" ", F.regexp_extract(n, "(?s)^[^,]*,(.*)$", 1), F.split_part(n, F.lit(","), F.lit(1)))).otherwise(n)
    return F.trim(F.regexp_replace(F.regexp_replace(without_marks(n), r"[.-]", " "), r"\s+", " "))


def let(value: Column, fn) -> Column:
    """fn(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def name_parts(c: Column) -> Column:
    return F.split(clean_name(c), " ")


def _surname(p: Column) -> Column:
    last, before = F.element_at(p, -1), F.try_element_at(p, F.lit(-2))
    return F.when((F.size(p) > 1) & before.isin(*PARTICLES), F.concat_ws(" ", before, last)).otherwise(last)


def surname(c: Column) -> Column:
    """Last word of a name, with a particle before it."""
    return let(name_parts(c), _surname)


def name_struct(c: Column) -> Column:
    """struct of the cleaned name: whole, given, last."""
    return let(
        name_parts(c), lambda p: F.struct(F.array_join(p, " ").alias("whole"), F.when(F.size(p) > 1, F.element_at(p, 1)).otherwise("").alias("given"), _surname(p).alias("last"))
    )


def variant_of(a: Column, b: Column) -> Column:
    """Equal, or either is listed as a spelling of the other."""
    known = F.create_map(*[x for k, v in VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    listed = lambda x, y: F.coalesce(F.array_contains(F.try_element_at(known, x), y), F.lit(False))
    return (a == b) | listed(a, b) | listed(b, a)


def compare_names(a: Column, b: Column) -> Column:
    """1 equal, 0 other surname, .6 a surname alone, .95 equal or variant given names, .85 an initial, else .4."""
    return let(F.struct(name_struct(a).alias("a"), name_struct(b).alias("b")), lambda s: compare_structs(s["a"], s["b"]))


def compare_structs(x: Column, y: Column) -> Column:
    gx, gy = x["given"], y["given"]
    initial = ((F.char_length(gx) == 1) & gy.startswith(gx)) | ((F.char_length(gy) == 1) & gx.startswith(gy))
    return (
        F.when(~present(x["whole"]) | ~present(y["whole"]), 0.0)
        .when(x["whole"] == y["whole"], 1.0)
        .when(~variant_of(x["last"], y["last"]), 0.0)
        .when((gx == "") | (gy == ""), 0.6)
        .when(variant_of(gx, gy), 0.95)
        .when(initial, 0.85)
        .otherwise(0.4)
    )


def compare_lists(ref: Column, paper: Column) -> Column:
    """Greedy matching in the reference's order, each name taking the best unused one of at least .4.

    struct: overall, injection, removal, reordered, first_off, matched, unmatched_ref, unmatched_paper. A fold over the names, in the JVM.
    """
    kind = "struct<used:array<int>,total:double,matched:int>"
    full = "struct<used:array<int>,total:double,matched:int,first_off:boolean,reordered:boolean>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("total"), F.lit(0).alias("matched")).cast(kind)

    def taken(s: Column, best: Column) -> Column:
        more = F.struct(F.array_append(s["used"], -best["k"]).alias("used"), (s["total"] + best["c"]).alias("total"), (s["matched"] + 1).alias("matched"))
        return F.when(best.isNull(), s).otherwise(more).cast(kind)

    def fold(both: Column) -> Column:
        def place(s: Column, name: Column) -> Column:
            options = F.filter(F.transform(both["p"], lambda p, i: F.struct(compare_structs(name, p).alias("c"), (-i).alias("k"))), lambda o: (o["c"] >= 0.4) & ~F.array_contains(s["used"], -o["k"]))
            return let(F.array_max(options), lambda best: taken(s, best))

        one = F.try_element_at(both["r"], F.lit(1))
        off = (F.size(both["r"]) > 0) & (F.size(both["p"]) > 0) & F.coalesce(compare_structs(one, F.try_element_at(both["p"], F.lit(1))) == 0.0, F.lit(False))
        later = F.exists(both["p"], lambda p: compare_structs(one, p) >= 0.8)
        return let(F.aggregate(both["r"], start, place), lambda s: F.struct(s["used"].alias("used"), s["total"].alias("total"), s["matched"].alias("matched"), off.alias("first_off"), (off & later).alias("reordered")).cast(full))

    n, m = F.size(ref), F.size(paper)
    return let(
        let(F.struct(F.transform(ref, name_struct).alias("r"), F.transform(paper, name_struct).alias("p")), fold),
        lambda s: F.struct(
            F.when((n <= 0) | (m <= 0) | (s["matched"] == 0), 0.0).otherwise(F.greatest(F.lit(0.0), s["total"] / F.greatest(n, m) - 0.1 * (n - s["matched"]) - 0.05 * (m - s["matched"]))).alias("overall"),
            F.when((n > 0) & (m <= 0), True).otherwise((n > s["matched"]) & (s["matched"] >= 2)).alias("injection"),
            F.when((m > 0) & (n <= 0), True).otherwise((m > s["matched"]) & (s["matched"] >= 1)).alias("removal"),
            s["reordered"].alias("reordered"),
            s["first_off"].alias("first_off"),
            s["matched"].alias("matched"),
            (n - s["matched"]).alias("unmatched_ref"),
            (m - s["matched"]).alias("unmatched_paper"),
        ),
    )


def doi_author_similarity(ref: Column, paper: Column) -> Column:
    """Share of names with a counterpart whose words overlap by .6."""
    bare = lambda names: F.transform(names, lambda a: F.regexp_replace(F.lower(a), "[.,]", ""))
    hit = F.size(F.filter(bare(ref), lambda a: F.exists(bare(paper), lambda b: (b != "") & (token_jaccard(a, b) >= 0.6))))
    return F.when((F.size(ref) <= 0) | (F.size(paper) <= 0), 0.0).otherwise(hit / F.greatest(F.size(ref), F.size(paper)))


def surnames(names: Column) -> Column:
    return F.array_distinct(F.transform(names, surname))


def shared_surnames(x: Column, y: Column) -> Column:
    """Shared over all of two lists of distinct surnames; 0 if either is empty."""
    return F.when((F.size(x) <= 0) | (F.size(y) <= 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def surname_jaccard(ref: Column, paper: Column) -> Column:
    return let(F.struct(surnames(ref).alias("x"), surnames(paper).alias("y")), lambda s: shared_surnames(s["x"], s["y"]))


def normalise_venue(c: Column) -> Column:
    v = F.lower(c)
    for pattern, to in VENUE_RULES:
        v = F.regexp_replace(v, pattern, to)
    return v


def canonical_venue(c: Column) -> Column:
    """The first venue with an alias that equals, holds or is held by the normalised name; the name itself if none."""
    return let(normalise_venue(c), _canonical)


def _aliases(own_name: bool) -> Column:
    """The venues' table as an array of (name, alias), in order; with the name itself after its aliases, if wanted."""
    rows = [(name, alias) for name, aliases in VENUES for alias in (*aliases, name)[: len(aliases) + own_name]]
    return F.expr("array(" + ", ".join(f"struct('{name}' AS name, '{alias}' AS alias)" for name, alias in rows) + ")")


def _canonical(v: Column) -> Column:
    first = lambda test: F.get(F.filter(_aliases(True), test), F.lit(0))["name"]
    return F.coalesce(first(lambda x: x["alias"] == v), first(lambda x: F.contains(v, x["alias"]) | F.contains(x["alias"], v)), v)


def venue_struct(c: Column) -> Column:
    """struct of a venue: its normalised name, canonical venue, words, and the venues with an alias in the name."""
    stop = F.array(*map(F.lit, ["", *VENUE_STOP]))

    def parts(v: Column) -> Column:
        held = F.array_distinct(F.transform(F.filter(_aliases(False), lambda x: F.contains(v, x["alias"])), lambda x: x["name"]))
        return F.struct(v.alias("v"), _canonical(v).alias("canon"), F.array_except(F.array_distinct(F.split(v, r"\s+")), stop).alias("words"), held.alias("held"), present(c).alias("any"))

    return let(normalise_venue(c), parts)


def venue_similarity(a: Column, b: Column, exact: bool = False) -> Column:
    """0 missing, 1 equal, .95 one venue, .85 containment or a shared alias, else from the overlap of words.

    Below half of the words: the sequence ratio of the names if exact, else the overlap, which needs no Python.
    """
    fast = let(F.struct(venue_struct(a).alias("a"), venue_struct(b).alias("b")), lambda s: compare_venues(s["a"], s["b"]))
    if not exact:
        return fast
    return F.when(fast >= 0.7, fast).when(~present(a) | ~present(b), 0.0).otherwise(sequence_ratio(normalise_venue(a), normalise_venue(b)))


def compare_venues(a: Column, b: Column) -> Column:
    x, y = a["v"], b["v"]
    fewest, most = F.least(F.size(a["words"]), F.size(b["words"])), F.greatest(F.size(a["words"]), F.size(b["words"]))
    overlap = F.when(fewest == 0, 0.0).otherwise(F.size(F.array_intersect(a["words"], b["words"])) / F.greatest(most, F.lit(1)))
    return (
        F.when(~a["any"] | ~b["any"], 0.0)
        .when(x == y, 1.0)
        .when(a["canon"] == b["canon"], 0.95)
        .when(x.contains(y) | y.contains(x), 0.85)
        .when(F.arrays_overlap(a["held"], b["held"]), 0.85)
        .when(overlap >= 0.5, 0.7 + 0.2 * overlap)
        .otherwise(overlap)
    )


def venue_tier(c: Column) -> Column:
    out = F.lit("other")
    for tier, words in reversed(TIERS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(c).contains(w)
        out = F.when(hit, tier).otherwise(out)
    return F.when(~present(c), "unknown").otherwise(out)


def implausible_venue(claimed: Column, found: Column) -> Column:
    """A leading journal is claimed where a preprint, a workshop or a venue of no tier was found."""
    return (venue_tier(claimed) == "tier1_journals") & venue_tier(found).isin("preprints", "workshops", "other")


def year_linear(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0.0).when(d == 0, 1.0).when(d <= 3, 1.0 - d / 3.0).otherwise(0.0)


def year_asymmetric(ref: Column, paper: Column) -> Column:
    """Newer than the paper: .7 .4 .1; older: .9 .8 .6 .3; missing: .5."""
    d = ref - paper
    return (
        F.when(ref.isNull() | paper.isNull(), 0.5)
        .when(d == 0, 1.0)
        .when(d == 1, 0.7).when((d > 1) & (d <= 2), 0.4).when(d > 2, 0.1)
        .when(d == -1, 0.9).when(d == -2, 0.8).when(d >= -4, 0.6)
        .otherwise(0.3)
    )


def year_stepped(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0.0).when(d == 0, 1.0).when(d == 1, 0.5).when(d == 2, 0.2).otherwise(0.0)


def credibility(source: Column) -> Column:
    out = F.lit(DEFAULT_CREDIBILITY)
    for name, value in CREDIBILITY.items():
        out = F.when(F.lower(source) == name, value).otherwise(out)
    return out
