"""Literature and annotation payloads: records to rows of documents, mentions and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.common import conform, json_documents, many, mixed_text, one, xml_records


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """PubmedArticle records; a labelled abstract keeps its labels, inline markup is kept once."""
    x = F.col("xml")
    abstract = F.array_join(F.filter(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.regexp_replace(F.get(F.regexp_extract_all(x, F.lit(r"(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), F.lit(1)), i - 1), "<[^>]*>", "")), lambda t: t.isNotNull() & (t != "")), "\n")
    year = F.coalesce(one(x, "//JournalIssue/PubDate/Year"), F.nullif(F.regexp_extract(F.coalesce(one(x, "//JournalIssue/PubDate/MedlineDate"), F.lit("")), r"(\d{4})", 1), F.lit("")))
    authors = F.transform(F.regexp_extract_all(x, F.lit(r"(?s)<Author[ >].*?</Author>"), F.lit(0)), lambda a: F.struct(
        F.nullif(F.regexp_extract(a, r"<CollectiveName>(.*?)</CollectiveName>", 1), F.lit("")).alias("collective"), F.nullif(F.regexp_extract(a, r"<LastName>(.*?)</LastName>", 1), F.lit("")).alias("last"),
        F.nullif(F.regexp_extract(a, r"<ForeName>(.*?)</ForeName>", 1), F.lit("")).alias("fore"), F.nullif(F.regexp_extract(a, r"<Initials>(.*?)</Initials>", 1), F.lit("")).alias("initials"),
        F.regexp_extract_all(a, F.lit(r"(?s)<Affiliation>(.*?)</Affiliation>"), F.lit(1)).alias("affiliations")))
    pmid = one(x, "//MedlineCitation/PMID")
    rows = xml_records(spark, path, "PubmedArticle").select(
        F.lit("pubmed").alias("source"), pmid.alias("source_id"), mixed_text(x, "//ArticleTitle").alias("title"), F.nullif(abstract, F.lit("")).alias("abstract"), one(x, "//Journal/Title").alias("journal"), year.try_cast("int").alias("year"),
        one(x, "//ArticleId[@IdType='doi']").alias("doi"), one(x, "//Language").alias("language"), authors.alias("authors"), many(x, "//MeshHeading/DescriptorName").alias("mesh_terms"), many(x, "//KeywordList/Keyword").alias("keywords"), many(x, "//PublicationTypeList/PublicationType").alias("publication_types"),
        F.to_json(F.struct(pmid.alias("pmid"))).alias("raw_metadata"),
    )
    return conform(rows.where("source_id IS NOT NULL"), "documents")


def full_text(spark: SparkSession, path: str, canonical: dict[str, str]) -> DataFrame:
    """JATS articles: sections under canonical names as ``## Name`` blocks, in the order they first come."""
    x = F.col("xml")
    sections = F.regexp_extract_all(F.regexp_extract(x, r"(?s)<body[^>]*>(.*)</body>", 1), F.lit(r"(?s)<sec[^>]*>.*?</sec>"), F.lit(0))
    table = F.create_map(*[F.lit(v) for pair in canonical.items() for v in pair])
    title = lambda s: F.trim(F.regexp_replace(F.regexp_extract(s, r"(?s)<title>(.*?)</title>", 1), "<[^>]*>", ""))
    body = lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", ""), r"\s+", " "))), "\n\n")
    blocks = F.transform(sections, lambda s: F.concat(F.lit("## "), F.coalesce(F.try_element_at(table, F.lower(title(s))), title(s)), F.lit("\n\n"), body(s)))
    rows = xml_records(spark, path, "article").select(
        F.lit("pmc").alias("source"), F.regexp_replace(one(x, "//article-id[@pub-id-type='pmc' or @pub-id-type='pmcid']"), "^PMC", "").alias("source_id"), mixed_text(x, "//article-title").alias("title"), mixed_text(x, "//abstract").alias("abstract"), one(x, "//journal-title").alias("journal"),
        one(x, "//pub-date/year").try_cast("int").alias("year"), one(x, "//article-id[@pub-id-type='doi']").alias("doi"), F.to_json(F.struct(one(x, "//article-id[@pub-id-type='pmid']").alias("pmid"), F.array_join(blocks, "\n\n").alias("full_text"))).alias("raw_metadata"),
    )
    return conform(rows.where("source_id IS NOT NULL"), "documents")


WORKS = "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,`container-title`:array<string>,issued:struct<`date-parts`:array<array<int>>>,language:string,publisher:string,type:string,author:array<struct<family:string,given:string,affiliation:array<struct<name:string>>>>>>>"


def crossref(spark: SparkSession, path: str) -> DataFrame:
    """Pages of works; a work without a title or identifier is no document."""
    w = json_documents(spark, path, WORKS).select(F.explode("message.items").alias("w")).select("w.*")
    authors = F.transform("author", lambda a: F.struct(F.lit(None).cast("string").alias("collective"), a["family"].alias("last"), a["given"].alias("fore"), F.lit(None).cast("string").alias("initials"), F.transform(a["affiliation"], lambda p: p["name"]).alias("affiliations")))
    doi, title = F.lower(F.trim("DOI")), F.nullif(F.trim(F.get("title", F.lit(0))), F.lit(""))
    rows = w.select(F.lit("crossref").alias("source"), doi.alias("source_id"), title.alias("title"), F.nullif(F.trim(F.regexp_replace("abstract", "<[^>]*>", " ")), F.lit("")).alias("abstract"), F.get("container-title", F.lit(0)).alias("journal"), F.get(F.get(F.col("issued")["date-parts"], F.lit(0)), F.lit(0)).alias("year"), doi.alias("doi"), "language", authors.alias("authors"), F.array().cast("array<string>").alias("publication_types"), F.to_json(F.struct(doi.alias("doi"), "publisher", "type")).alias("raw_metadata"))
    return conform(rows.where("title IS NOT NULL AND source_id <> ''"), "documents")


SERIES = "uid string, accession string, title string, summary string, gpl string, taxon string, entrytype string, gdstype string, pdat string, n_samples int"


def expression_series(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of expression series as documents; other entries are left out."""
    s = json_documents(spark, path, SERIES).where("entrytype = 'GSE'")
    rows = s.select(F.lit("geo").alias("source"), F.col("accession").alias("source_id"), "title", F.col("summary").alias("abstract"), F.lit("NCBI GEO").alias("journal"), F.substring("pdat", 1, 4).try_cast("int").alias("year"), F.array_compact(F.array("taxon")).alias("keywords"), F.array_compact(F.array("gdstype")).alias("publication_types"), F.to_json(F.struct("uid", "gpl", "n_samples")).alias("raw_metadata"))
    return conform(rows, "documents")


_INFONS = "struct<type:string,identifier:string,name:string,section_type:string,score:string,role1:struct<type:string,identifier:string,name:string>,role2:struct<type:string,identifier:string,name:string>>"
ANNOTATED = f"PubTator3 array<struct<pmid:string,pmcid:string,passages:array<struct<infons:{_INFONS},offset:int,text:string,annotations:array<struct<infons:{_INFONS},text:string,locations:array<struct<offset:int,length:int>>>>>>,relations:array<struct<infons:{_INFONS}>>>>"


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """BioC exports: mentions (pmid, concept, text, offset, what follows) and scored relations."""
    d = json_documents(spark, path, ANNOTATED).select(F.explode("PubTator3").alias("d")).select("d.*")
    p = d.select("pmid", F.explode("passages").alias("p"))
    m = p.select("pmid", F.col("p.infons.type").alias("section"), F.col("p.offset").alias("start"), F.col("p.text").alias("body"), F.explode("p.annotations").alias("a"))
    place = F.get("a.locations", F.lit(0))
    end = place["offset"] - F.col("start") + place["length"]
    mentions = m.where("a.infons.identifier IS NOT NULL").select("pmid", "section", F.col("a.infons.type").alias("type"), F.col("a.infons.identifier").alias("identifier"), F.col("a.text").alias("text"), place["offset"].alias("offset"), F.substring("body", end + 1, F.lit(24)).alias("after"))
    r = d.select("pmid", F.explode("relations").alias("r")).where("r.infons.role1.identifier IS NOT NULL AND r.infons.role2.identifier IS NOT NULL")
    relations = r.select("pmid", F.col("r.infons.type").alias("type"), F.coalesce(F.col("r.infons.score").try_cast("double"), F.lit(0.0)).alias("score"), F.col("r.infons.role1.identifier").alias("first"), F.col("r.infons.role2.identifier").alias("second"))
    return mentions, relations


def headings(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Descriptor records (id, name, terms, trees) of the wanted identifiers only: a semi join while reading."""
    x = F.col("xml")
    rows = xml_records(spark, path, "DescriptorRecord").select(one(x, "/DescriptorRecord/DescriptorUI").alias("id"), one(x, "/DescriptorRecord/DescriptorName/String").alias("name"), many(x, "//Term/String").alias("terms"), many(x, "//TreeNumber").alias("trees"))
    return rows.join(wanted.select("id").distinct(), "id", "left_semi")


def gold_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PubTator-format gold files: passages (id, kind, text), mentions and relations, by the shape of the line."""
    lines = spark.read.text(path)
    text = lines.where(F.col("value").rlike(r"^\d+\|[ta]\|")).select(F.split_part("value", F.lit("|"), F.lit(1)).alias("id"), F.split_part("value", F.lit("|"), F.lit(2)).alias("kind"), F.regexp_replace("value", r"^\d+\|[ta]\|", "").alias("text"))
    cells = lines.where(F.col("value").contains("\t")).select(F.split("value", "\t").alias("c"))
    mentions = cells.where(F.get("c", F.lit(1)).rlike(r"^\d+$")).select(F.get("c", F.lit(0)).alias("id"), F.get("c", F.lit(1)).cast("int").alias("start"), F.get("c", F.lit(2)).cast("int").alias("end"), F.get("c", F.lit(3)).alias("text"), F.get("c", F.lit(4)).alias("type"), F.get("c", F.lit(5)).alias("concept"))
    relations = cells.where(~F.get("c", F.lit(1)).rlike(r"^\d+$")).select(F.get("c", F.lit(0)).alias("id"), F.get("c", F.lit(1)).alias("relation"), F.get("c", F.lit(2)).alias("first"), F.get("c", F.lit(3)).alias("second"))
    return text, mentions, relations


def gold_tables(spark: SparkSession, entities: str, relations: str) -> DataFrame:
    """Gold relations of two tables, entities (document, term, type, start, end, text) and relations (document, type, Arg1:term, Arg2:term): rows (id, relation, first, second, and their types)."""
    cell = lambda i: F.get("c", F.lit(i))
    e = spark.read.text(entities).select(F.split("value", "\t").alias("c")).select(cell(0).alias("id"), cell(1).alias("term"), cell(2).alias("type"), cell(5).alias("text"))
    r = spark.read.text(relations).select(F.split("value", "\t").alias("c")).select(cell(0).alias("id"), cell(1).alias("relation"), F.split_part(cell(2), F.lit(":"), F.lit(2)).alias("t1"), F.split_part(cell(3), F.lit(":"), F.lit(2)).alias("t2"))
    side = lambda n, name: e.select("id", F.col("term").alias(f"t{n}"), F.col("text").alias(name), F.col("type").alias(f"{name}_type"))
    return r.join(side(1, "first"), ["id", "t1"]).join(side(2, "second"), ["id", "t2"]).drop("t1", "t2")
