"""Sources: the bibliography derived from the documents, text files, and catalogue rows of other shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import let
from .storage import written

#: Fixed values of the derived bibliography. The SQL is the same in Spark and in other engines.
GIVEN = "Ada,Boris,C.,Dmitry,Eva,Farid,Grace,Hiro,Ines,J.,Karl"
FAMILY = "Lovelace,Petrov,van Dijk,O-Brien,Sanchez,Li,Hopper,Tanaka,Moreau,Smith,de Vries,Kowalski,Novak"
PLACES = "Proceedings of NeurIPS 2019|ICML|Advances in Cryptology CRYPTO 2020|Journal of Cryptology|VLDB|Workshop on Things|arXiv preprint|Nature"
SOURCES = "openalex,dblp,crossref,arxiv,pubmed,semantic_scholar,iacr"


def _name(k: str) -> str:
    return f"split_part('{GIVEN}', ',', CAST(({k}) % 11 AS INT) + 1) || ' ' || split_part('{FAMILY}', ',', CAST(({k}) % 13 AS INT) + 1)"


PAPERS = f"""
SELECT doc_id AS paper_id, split_part('{SOURCES}', ',', CAST(doc_id % 7 AS INT) + 1) AS source,
  substring(split_part(text, chr(10), 1), 1, 120) AS title,
  {_name("doc_id")} || '; ' || {_name("doc_id * 5 + 3")} || CASE WHEN doc_id % 3 = 0 THEN '; ' || {_name("doc_id * 7 + 1")} ELSE '' END AS authors,
  CAST(1980 + doc_id % 45 AS INT) AS year, split_part('{PLACES}', '|', CAST(doc_id % 8 AS INT) + 1) AS venue,
  '10.' || CAST(1000 + doc_id % 97 AS STRING) || '/d' || CAST(doc_id AS STRING) AS doi, CAST(doc_id % 60 AS INT) AS citations
FROM {{documents}}"""
REFS = f"""
SELECT paper_id AS ref_id,
  CASE WHEN paper_id % 10 = 6 THEN 'Unknown results ' || CAST(paper_id AS STRING) WHEN paper_id % 10 = 1 THEN title || ' revisited' ELSE title END AS title,
  CASE WHEN paper_id % 10 = 6 THEN 'Zed Nobody' WHEN paper_id % 10 = 3 THEN 'Mallory Forger; Trudy Intruder' WHEN paper_id % 10 = 4 THEN split_part(authors, '; ', 1) ELSE authors END AS authors,
  CASE WHEN paper_id % 10 = 2 THEN year + 1 WHEN paper_id % 10 = 7 THEN year + 2 ELSE year END AS year,
  CASE WHEN paper_id % 10 = 5 THEN 'Nature' ELSE venue END AS venue,
  CASE WHEN paper_id % 10 IN (3, 6, 8) THEN '' WHEN paper_id % 20 = 9 THEN 'https://doi.org/10.1/none' ELSE 'https://doi.org/' || doi END AS doi
FROM ({PAPERS}) p"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(PAPERS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumn("authors", F.split("authors", "; "))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(REFS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumn("authors", F.split("authors", "; "))


#: What `PAPERS` takes of a text: taken twice, it stays the same.
HEADS = "SELECT doc_id, substring(split_part(text, chr(10), 1), 1, 120) AS text FROM {documents}"


def heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """references and papers, for what reads both many times: whole texts are read once, and their heads are written."""
    docs = written(spark.sql(HEADS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet")), "heads")
    return tuple(spark.sql(q, documents=docs).withColumn("authors", F.split("authors", "; ")) for q in (REFS, PAPERS))


def assemble(lines: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, pos, raw_text): records of text files; a line that opens with a digit, -, * or a bullet begins one, others go on.

    Blank lines go. A file without such a line is one record. A file is one row in and stays in its row: no shuffle.
    """
    rows = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))), lambda x: x != "")
    marks = F.transform(rows, lambda x, k: F.when((k == 0) | x.rlike(r"^[0-9*•-]"), k))

    def cut(r: Column) -> Column:
        ends = F.concat(F.slice(r["starts"], 2, F.greatest(F.size(r["starts"]) - 1, F.lit(0))), F.array(F.size(r["rows"])))
        return F.zip_with(r["starts"], ends, lambda a, z: F.array_join(F.slice(r["rows"], a + 1, z - a), " "))

    folded = F.when(F.size(rows) > 0, let(F.struct(rows.alias("rows"), F.array_compact(marks).alias("starts")), cut))
    return lines.select(file, F.posexplode(folded).alias("pos", "raw_text"))


def from_openalex(raw: Column) -> Column:
    """JSON of a work -> struct of the canonical paper."""
    w = F.from_json(raw, "id string, doi string, title string, publication_year int, cited_by_count long, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string,host_organization_name:string>>")
    return F.struct(
        F.lit("openalex").alias("source"), F.regexp_replace(w["id"], "^https://openalex.org/", "").alias("paper_id"), w["title"].alias("title"),
        F.array_compact(F.transform(w["authorships"], lambda a: a["author"]["display_name"])).alias("authors"), w["publication_year"].alias("year"),
        w["primary_location"]["source"]["display_name"].alias("venue"), F.regexp_replace(w["doi"], "^https://doi.org/", "").alias("doi"), w["cited_by_count"].alias("citations"),
        w["primary_location"]["source"]["host_organization_name"].alias("publisher"),
    )


def from_crossref(raw: Column) -> Column:
    date = "struct<`date-parts`:array<array<int>>>"
    w = F.from_json(raw, f"DOI string, title array<string>, author array<struct<given:string,family:string>>, `container-title` array<string>, `published-print` {date}, `published-online` {date}, created {date}, publisher string, `is-referenced-by-count` long")
    year = F.coalesce(*[F.try_element_at(F.try_element_at(w[k]["date-parts"], F.lit(1)), F.lit(1)) for k in ("published-print", "published-online", "created")])
    return F.struct(
        F.lit("crossref").alias("source"), w["DOI"].alias("paper_id"), F.try_element_at(w["title"], F.lit(1)).alias("title"),
        F.transform(w["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"), year.alias("year"),
        F.try_element_at(w["container-title"], F.lit(1)).alias("venue"), w["DOI"].alias("doi"), w["is-referenced-by-count"].alias("citations"), w["publisher"].alias("publisher"),
    )


def from_dblp(raw: Column) -> Column:
    """A hit's info; authors may be one or a list, each an object with a text or the text itself."""
    v = F.try_parse_json(raw)
    name = lambda a: F.coalesce(F.try_variant_get(a, "$.text", "string"), F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string")))
    many = F.array_compact(F.transform(F.try_variant_get(v, "$.authors.author", "array<variant>"), name))
    one = name(F.try_variant_get(v, "$.authors.author", "variant"))
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    return F.struct(
        F.lit("dblp").alias("source"), get("$.key").alias("paper_id"), F.regexp_replace(get("$.title"), r"\.$", "").alias("title"),
        F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")).alias("authors"),
        get("$.year").try_cast("int").alias("year"), get("$.venue").alias("venue"), get("$.doi").alias("doi"), F.lit(None).cast("long").alias("citations"), get("$.publisher").alias("publisher"),
    )


def from_semantic_scholar(raw: Column) -> Column:
    w = F.from_json(raw, "paperId string, title string, year int, venue string, citationCount long, authors array<struct<name:string>>, externalIds struct<DOI:string>")
    return F.struct(
        F.lit("semantic_scholar").alias("source"), w["paperId"].alias("paper_id"), w["title"].alias("title"), F.transform(w["authors"], lambda a: a["name"]).alias("authors"),
        w["year"].alias("year"), w["venue"].alias("venue"), w["externalIds"]["DOI"].alias("doi"), w["citationCount"].alias("citations"), F.lit(None).cast("string").alias("publisher"),
    )


def from_arxiv(entry: Column) -> Column:
    """An Atom entry; its DOI is the link."""
    x = lambda p: F.nullif(F.xpath_string(entry, F.lit(p)), F.lit(""))
    return F.struct(
        F.lit("arxiv").alias("source"), F.regexp_extract(x("//*[local-name()='id']"), r"([^/]+)$", 1).alias("paper_id"), x("//*[local-name()='title']").alias("title"),
        F.xpath(entry, F.lit("//*[local-name()='author']/*[local-name()='name']/text()")).alias("authors"), F.substring(x("//*[local-name()='published']"), 1, 4).try_cast("int").alias("year"),
        F.lit("ArXiv").alias("venue"), x("//*[local-name()='doi']").alias("doi"), F.lit(None).cast("long").alias("citations"), F.lit(None).cast("string").alias("publisher"),
    )


def from_tei(xml: Column) -> Column:
    """A biblStruct -> struct of a reference; namespaces are ignored."""
    x = lambda *ps: F.coalesce(*[F.nullif(F.trim(F.xpath_string(xml, F.lit(p))), F.lit("")) for p in ps])
    n = lambda name, more="": f"//*[local-name()='{name}'{more}]"
    first, last = (F.xpath(xml, F.lit(f"{n('author')}/*[local-name()='persName']/*[local-name()='{k}'][1]/text()")) for k in ("forename", "surname"))
    pages = n("biblScope", " and @unit='page'")
    return F.struct(
        x(n("title", " and @level='a'"), n("title", " and @type='main'"), n("title", " and not(@level='j')")).alias("title"),
        F.zip_with(first, last, lambda a, b: F.concat_ws(" ", a, b)).alias("authors"), x(n("title", " and @level='j'"), n("title", " and @level='m'")).alias("venue"),
        F.substring(x(n("date") + "/@when", n("date")), 1, 4).try_cast("int").alias("year"), x(n("biblScope", " and @unit='volume'")).alias("volume"),
        x(n("biblScope", " and @unit='issue'")).alias("issue"), F.coalesce(F.nullif(F.concat_ws("-", x(pages + "/@from"), x(pages + "/@to")), F.lit("")), x(pages)).alias("pages"),
        x(n("idno", " and @type='DOI'"), n("idno", " and contains(., '10.')")).alias("doi"), x(n("ptr") + "/@target").alias("url"),
    )


def from_pubmed(xml: Column) -> Column:
    """A PubmedArticle; authors need a surname, and its journal is the venue."""
    x = lambda p: F.nullif(F.xpath_string(xml, F.lit(p)), F.lit(""))
    names = F.xpath(xml, F.lit("//Article//AuthorList/Author[LastName]/LastName/text()"))
    with_given, given = (F.xpath(xml, F.lit(f"//Article//AuthorList/Author[LastName and ForeName]/{k}/text()")) for k in ("LastName", "ForeName"))
    whole = F.zip_with(given, with_given, lambda a, b: F.concat_ws(" ", a, b))
    one_by_one = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.get(names, k - 1))
    authors = F.when(F.size(names) == 0, F.array().cast("array<string>")).when(F.size(names) == F.size(whole), whole).otherwise(F.transform(one_by_one, lambda n: F.coalesce(F.try_element_at(F.filter(whole, lambda w: F.endswith(w, F.concat(F.lit(" "), n))), F.lit(1)), n)))
    return F.struct(
        F.lit("pubmed").alias("source"), x("//PMID[1]").alias("paper_id"), F.trim(F.regexp_replace(F.coalesce(x("//Article//ArticleTitle"), F.lit("")), "<[^>]+>", "")).alias("title"),
        authors.alias("authors"), x("//Journal//PubDate/Year").try_cast("int").alias("year"), x("//Journal//Title").alias("venue"), x("//ArticleId[@IdType='doi']").alias("doi"),
        F.lit(None).cast("long").alias("citations"), F.lit(None).cast("string").alias("publisher"), x("//JournalIssue/Volume").alias("volume"), x("//JournalIssue/Issue").alias("issue"),
        x("//Pagination/MedlinePgn").alias("pages"),
    )


def from_springer(raw: Column) -> Column:
    """A record; the year is the first of its date, the pages run from the first to the last."""
    w = F.from_json(raw, "title string, creators array<struct<creator:string>>, publicationDate string, onlineDate string, publicationName string, doi string, url string, volume string, startingPage string, endingPage string")
    text = lambda c: F.trim(F.coalesce(w[c], F.lit("")))
    date = F.coalesce(F.nullif(w["publicationDate"], F.lit("")), w["onlineDate"])
    pages = F.when((text("startingPage") != "") & (text("endingPage") != ""), F.concat(text("startingPage"), F.lit("-"), text("endingPage"))).otherwise(text("startingPage"))
    names = F.filter(F.transform(w["creators"], lambda a: F.trim(a["creator"])), lambda n: n != "")
    return F.struct(
        F.lit("springer").alias("source"), text("doi").alias("paper_id"), text("title").alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.regexp_extract(date, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int").alias("year"), text("publicationName").alias("venue"), text("doi").alias("doi"), F.lit(None).cast("long").alias("citations"),
        F.lit("Springer").alias("publisher"), text("volume").alias("volume"), pages.alias("pages"),
        F.coalesce(F.nullif(text("url"), F.lit("")), F.when(text("doi") != "", F.concat(F.lit("https://doi.org/"), text("doi")))).alias("url"),
    )


def from_scholar(raw: Column) -> Column:
    """A hit of a scholar search; authors are split at 'and', and a missing snippet is the title."""
    w = F.from_json(raw, "bib struct<title:string,author:string,pub_year:string,venue:string,abstract:string>, pub_url string, eprint_url string, num_citations string")
    b, title = w["bib"], F.trim(F.coalesce(w["bib"]["title"], F.lit("")))
    names = F.transform(F.split(F.nullif(b["author"], F.lit("")), " and "), lambda n: F.trim(n))
    return F.struct(
        F.lit("google_scholar").alias("source"), title.alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), b["pub_year"].try_cast("int").alias("year"),
        F.trim(F.coalesce(b["venue"], F.lit(""))).alias("venue"), F.coalesce(F.nullif(w["pub_url"], F.lit("")), w["eprint_url"]).alias("url"), w["num_citations"].try_cast("long").alias("citations"),
        F.coalesce(F.nullif(F.trim(b["abstract"]), F.lit("")), title).alias("snippet"),
    )


def from_rss(item: Column) -> Column:
    """An item of the feed of cryptology preprints; the number at its link's end is its id, and gives the year if no date does."""
    x = lambda *ps: F.coalesce(*[F.nullif(F.trim(F.xpath_string(item, F.lit(p))), F.lit("")) for p in ps])
    n = lambda name: f"//*[local-name()='{name}']"
    number = F.regexp_extract(x(n("link")), r"/([0-9]{4}/[0-9]+)/?$", 1)
    dated = F.regexp_extract(x(n("pubDate"), n("date"), n("updated")), r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    return F.struct(
        F.lit("iacr").alias("source"), number.alias("paper_id"), x(n("title")).alias("title"), F.xpath(item, F.lit(f"{n('creator')}/text() | {n('author')}/text()")).alias("authors"),
        F.coalesce(dated, F.substring(number, 1, 4).try_cast("int")).alias("year"), F.lit("IACR Cryptology ePrint Archive").alias("venue"), F.lit(None).cast("string").alias("doi"),
        F.lit(None).cast("long").alias("citations"), F.lit(None).cast("string").alias("publisher"), x(n("link")).alias("url"), x(n("category"), n("subject")).alias("category"), x(n("description"), n("summary")).alias("description"),
    )
