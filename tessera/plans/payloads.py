"""Queries over sources and sinks (inventory S, K): payload files in the published shapes are written from the driver tables and read back.

The files lie in the shared folder, as a real payload cache would; every reader gets the
whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import new_folder
from tessera.plans.registry import load, query
from tessera.sources import common, knowledge, literature, registries, sinks

PAGE = 200


def folder(spark: SparkSession) -> str:
    """A new folder for payloads, deleted with the session."""
    return new_folder(spark, "payload")


def files(rows: DataFrame, content: Column) -> str:
    """One line of text for each row, in files of any number."""
    name = folder(rows.sparkSession)
    rows.select(content.alias("value")).write.text(name)
    return name


def whole_files(rows: DataFrame, key: Column, content: Column) -> str:
    """One file for each row, below a folder of its key."""
    name = folder(rows.sparkSession)
    rows.select(content.alias("value"), key.alias("file")).repartition("file").write.partitionBy("file").text(name)
    return name


def pages(rows: DataFrame, key: str, value: Column, page: Column) -> str:
    """One JSON file for each PAGE rows: ``page`` makes the document of the list ``items``."""
    grouped = rows.select(F.expr(f"{key} div {PAGE}").alias("n"), value.alias("v")).groupBy("n").agg(F.collect_list("v").alias("items"))
    return whole_files(grouped, F.col("n"), page)


def tag(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), value if isinstance(value, Column) else F.lit(value), F.lit(f"</{name.split()[0]}>"))


def text_of(name: str) -> Column:
    return F.col(name).cast("string")


@query("src01_pubmed", "SELECT p_partkey::VARCHAR AS source_id, p_name AS title, p_type || chr(10) || p_brand AS abstract, p_brand AS journal, 1950 + p_size AS year, ['h' || p_size] AS mesh_terms, 'L' || p_size AS first_author FROM part")
def src01(spark, d):
    name = F.split("p_name", " ", 2)
    title = F.concat(tag("i", F.get(name, F.lit(0))), F.when(F.size(name) > 1, F.concat(F.lit(" "), F.get(name, F.lit(1)))).otherwise(""))
    size = text_of("p_size")
    article = F.concat(
        tag("Journal", F.concat(tag("Title", F.col("p_brand")), tag("JournalIssue", tag("PubDate", tag("Year", (F.col("p_size") + 1950).cast("string")))))), tag("ArticleTitle", title),
        tag("Abstract", F.concat(tag("AbstractText Label='A'", F.concat(F.lit("<b>"), "p_type", F.lit("</b>"))), tag("AbstractText", F.col("p_brand")))),
        tag("AuthorList", tag("Author", tag("LastName", F.concat(F.lit("L"), size)))),
    )
    heading = tag("MeshHeadingList", tag("MeshHeading", tag("DescriptorName", F.concat(F.lit("h"), size))))
    record = tag("PubmedArticle", tag("MedlineCitation", F.concat(tag("PMID", text_of("p_partkey")), tag("Article", article), heading)))
    found = literature.pubmed(spark, files(load(spark, d, "part"), record))
    return found.select("source_id", "title", "abstract", "journal", "year", "mesh_terms", F.get("authors", F.lit(0))["last"].alias("first_author"))


@query("src02_ranges", "SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1")
def src02(spark, d):
    """A listing that gives at most so many rows a question: years are bisected until each part fits, and all parts are read."""
    o = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"))
    by_year = {r.year: r.n for r in o.groupBy("year").agg(F.count("*").alias("n")).collect()}  # one row a year
    parts = common.ranges(min(by_year), max(by_year), lambda a, b: sum(by_year.get(y, 0) for y in range(a, b + 1)), max(by_year.values()) * 2)
    found = [o.where(F.col("year").between(a, b)).select("day") for a, b in parts]
    return common.union_all(found).groupBy("day").agg(F.count("*").alias("n"))


@query("src03_mixed_text", "SELECT p_partkey, p_name || ' of ' || p_brand AS title FROM part")
def src03(spark, d):
    xml = tag("r", tag("t", F.concat(F.lit("\n <i>"), "p_name", F.lit("</i>\n  of <b>"), "p_brand", F.lit("</b> "))))
    return load(spark, d, "part").select("p_partkey", common.mixed_text(xml, "/r/t").alias("title"))


@query("src04_full_text", "SELECT p_partkey::VARCHAR AS source_id, '## Methods' || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '## Aims' || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || 'end' AS body FROM part")
def src04(spark, d):
    sec = lambda title, *ps: tag("sec", F.concat(tag("title", title), *[tag("p", p) for p in ps]))
    front = tag("front", F.concat(F.lit("<article-id pub-id-type='pmc'>PMC"), text_of("p_partkey"), F.lit("</article-id>"), tag("article-title", F.col("p_name"))))
    body = tag("body", F.concat(sec("Materials and Methods", F.concat(F.lit("<i>"), "p_type", F.lit("</i>"))), sec("Aims", F.col("p_brand"), F.lit("end"))))
    found = literature.full_text(spark, files(load(spark, d, "part"), tag("article", F.concat(front, body))), {"materials and methods": "Methods"})
    return found.select("source_id", F.get_json_object("raw_metadata", "$.full_text").alias("body"))


@query("src05_licences", "SELECT 'PMC' || s_suppkey AS pmcid, 'CC BY ' || s_nationkey AS licence FROM supplier")
def src05(spark, d):
    s = load(spark, d, "supplier").select(F.concat(F.lit("PMC"), "s_suppkey").alias("Accession ID"), F.concat(F.lit("CC BY "), "s_nationkey").alias("License"))
    name = folder(spark)
    s.union(s).write.option("header", True).csv(name)
    return knowledge.licences(spark, name)


@query("src06_series", "SELECT 'GSE' || p_partkey AS source_id, p_name AS title, 1990 + p_size AS year FROM part WHERE p_size % 3 > 0")
def src06(spark, d):
    s = F.struct(F.concat(F.lit("GSE"), "p_partkey").alias("accession"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 > 0, "GSE").otherwise("GPL").alias("entrytype"), F.concat((F.col("p_size") + 1990).cast("string"), F.lit("/01/02")).alias("pdat"), F.lit(4).alias("n_samples"))
    return literature.expression_series(spark, pages(load(spark, d, "part"), "p_partkey", s, F.to_json("items"))).select("source_id", "title", "year")


@query("src07_payload_manifest", "SELECT length(b)::BIGINT + 1 AS bytes, sha256(b || chr(10)) AS sha256 FROM (SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS b FROM nation GROUP BY 1)")
def src07(spark, d):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",")
    kept = whole_files(load(spark, d, "nation").groupBy("n_regionkey").agg(names.alias("b")), F.col("n_regionkey"), F.col("b"))
    manifest = common.payload_manifest(spark, kept)
    whole = common.damaged(manifest, manifest).select("path")
    return manifest.join(whole, "path", "left_anti").select("bytes", "sha256")


@query("src08_series_samples", "SELECT 'GSM' || s_suppkey AS sample, s_name AS title, 'skin ' || s_nationkey AS tissue FROM supplier")
def src08(spark, d):
    line = lambda field, value: F.concat(F.lit(field + "\t"), F.array_join(F.transform(F.col("items"), lambda x: F.concat(F.lit('"'), value(x), F.lit('"'))), "\t"))
    s = load(spark, d, "supplier").groupBy((F.col("s_suppkey") % 3).alias("series")).agg(F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey")).alias("items"))
    head = F.concat_ws("\n", line("!Sample_title", lambda x: x["s_name"]), line("!Sample_geo_accession", lambda x: F.concat(F.lit("GSM"), x["s_suppkey"])), line("!Sample_characteristics_ch1", lambda x: F.concat(F.lit("Tissue: skin "), x["s_nationkey"])), F.lit("!series_matrix_table_begin"))
    return knowledge.series_samples(spark, whole_files(s, F.col("series"), head)).select("sample", "title", F.col("characteristics")["tissue"].alias("tissue"))


@query("src09_expression_values", "SELECT 'p' || p_partkey AS probe, s AS sample, CASE s WHEN 'A' THEN p_retailprice WHEN 'B' THEN p_size::DOUBLE END AS value FROM part, (VALUES ('A'), ('B')) x(s) WHERE s = 'A' OR p_size % 2 = 0")
def src09(spark, d):
    rows = F.concat_ws("\t", F.concat(F.lit('"p'), "p_partkey", F.lit('"')), text_of("p_retailprice"), F.when(F.col("p_size") % 2 == 0, text_of("p_size")).otherwise("null"))
    p = load(spark, d, "part").groupBy(F.lit(1).alias("one")).agg(F.array_join(F.collect_list(rows), "\n").alias("body"))
    text = F.concat(F.lit('!Series_title\t"x"\n"ID_REF"\t"A"\t"B"\n'), "body", F.lit("\n!series_matrix_table_end"))
    return knowledge.expression_values(spark, whole_files(p, F.col("one"), text) + "/file=1")


@query("src10_probe_genes", "SELECT 'p' || p_partkey AS probe, p_brand AS gene FROM part WHERE p_size % 4 > 0")
def src10(spark, d):
    line = F.concat_ws("\t", F.concat(F.lit("p"), "p_partkey"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).when(F.col("p_size") % 8 == 0, "").otherwise(F.concat("p_brand", F.lit("///X"))), F.lit("x"))
    p = load(spark, d, "part").groupBy(F.lit(1).alias("one")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return knowledge.probe_genes(spark, whole_files(p, F.col("one"), F.concat(F.lit("#a comment\nID\tGene symbol\tnote\n"), "body")) + "/file=1")


@query("src10_gene_names", "SELECT s_suppkey::VARCHAR AS symbol_key, 'SYM' || s_suppkey AS symbol FROM supplier UNION ALL SELECT 'old' || s_suppkey, 'SYM' || s_suppkey FROM supplier WHERE s_nationkey % 2 = 0")
def src10b(spark, d):
    s = load(spark, d, "supplier")
    t = s.select(text_of("s_suppkey").alias("hgnc_id"), F.concat(F.lit("SYM"), "s_suppkey").alias("symbol"), F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("old"), "s_suppkey")).alias("prev_symbol"))
    name = folder(spark)
    t.write.options(header=True, sep="\t").csv(name)
    return knowledge.gene_names(spark, name).select(F.col("name").alias("symbol_key"), "symbol")


@query("src11_clinical_trials", """
SELECT 'NCT' || c_custkey AS source_id, c_name AS brief_title, CASE WHEN c_acctbal > 0 THEN 'COMPLETED' ELSE 'RECRUITING' END AS status, ['PHASE' || (1 + c_custkey % 3)] AS phases, list_sort(list_distinct(['Chile', 'Peru ' || c_nationkey])) AS countries, [c_mktsegment, 'second'] AS sponsors, (c_custkey % 500)::INTEGER AS enrollment_count, c_custkey % 2 = 0 AS has_results, 'drug ' || c_nationkey AS first_drug, 'week ' || (c_custkey % 52) AS time_frame FROM customer""")
def src11(spark, d):
    f, s = F.col, F.struct
    study = s(
        s(
            s(F.concat(F.lit(" NCT"), "c_custkey", F.lit(" ")).alias("nctId"), f("c_name").alias("briefTitle")).alias("identificationModule"), s(F.when(f("c_acctbal") > 0, "COMPLETED").otherwise("RECRUITING").alias("overallStatus")).alias("statusModule"),
            s(F.array(F.concat(F.lit("PHASE"), (f("c_custkey") % 3 + 1).cast("string"))).alias("phases"), s((f("c_custkey") % 500).alias("count")).alias("enrollmentInfo")).alias("designModule"),
            s(F.array(s(F.lit("DRUG").alias("type"), F.concat(F.lit("drug "), "c_nationkey").alias("name"))).alias("interventions")).alias("armsInterventionsModule"),
            s(F.array(s(F.lit("m").alias("measure"), F.concat(F.lit("week "), (f("c_custkey") % 52).cast("string")).alias("timeFrame"))).alias("primaryOutcomes")).alias("outcomesModule"),
            s(F.array(s(F.concat(F.lit(" Peru "), "c_nationkey").alias("country")), s(F.lit("Chile").alias("country")), s(F.lit(" ").alias("country")), s(F.lit("Chile").alias("country"))).alias("locations")).alias("contactsLocationsModule"),
            s(s(f("c_mktsegment").alias("name")).alias("leadSponsor"), F.array(s(F.lit("second").alias("name"))).alias("collaborators")).alias("sponsorCollaboratorsModule"),
        ).alias("protocolSection"),
        F.when(f("c_custkey") % 2 == 0, F.lit(True)).alias("hasResults"),
    )
    found = registries.clinical_trials(spark, pages(load(spark, d, "customer"), "c_custkey", study, F.to_json(s(f("items").alias("studies")))))
    return found.select("source_id", "brief_title", "status", "phases", "countries", "sponsors", "enrollment_count", "has_results", F.get("interventions", F.lit(0))["name"].alias("first_drug"), F.get("primary_outcomes", F.lit(0))["time_frame"].alias("time_frame"))


@query("src12_european_trials", """
SELECT '2024-' || c_custkey AS source_id, c_name AS brief_title, CASE c_custkey % 3 WHEN 0 THEN 'AUTHORISED' WHEN 1 THEN 'ENDED' END AS status, CASE WHEN c_custkey % 2 = 0 THEN ['PHASE2'] ELSE ['PHASE3'] END AS phases, ['France', 'Spain'] AS countries, ['a', c_mktsegment] AS conditions, (2000 + c_custkey % 25)::VARCHAR || '-03-15' AS first_posted_date, (c_custkey % 90)::INTEGER AS enrollment_count FROM customer""")
def src12(spark, d):
    k = F.col("c_custkey")
    row = F.struct(F.concat(F.lit("2024-"), k.cast("string")).alias("ctNumber"), (k % 3).cast("int").alias("ctStatus"), F.col("c_name").alias("ctTitle"), F.lit(" ").alias("shortTitle"), F.concat(F.lit("a; "), "c_mktsegment").alias("conditions"), F.array(F.lit("Spain:2"), F.lit("France:1"), F.lit("Spain:3")).alias("trialCountries"), F.when(k % 2 == 0, "Therapeutic exploratory (Phase II)").otherwise("Therapeutic confirmatory (Phase III)").alias("trialPhase"), F.concat(F.lit("15/03/"), (k % 25 + 2000).cast("string")).alias("decisionDateOverall"), (k % 90).cast("string").alias("totalNumberEnrolled"))
    found = registries.european_trials(spark, pages(load(spark, d, "customer"), "c_custkey", row, F.to_json(F.struct(F.col("items").alias("data")))), {0: "AUTHORISED", 1: "ENDED"})
    return found.select("source_id", "brief_title", "status", "phases", "countries", "conditions", "first_posted_date", "enrollment_count")


@query("src13_british_trials", "SELECT 'ISRCTN' || (10000000 + s_suppkey) AS source_id, s_name AS brief_title, 'Write to [email removed] now' AS summary, ['United Kingdom'] AS countries, (s_suppkey % 50)::INTEGER AS enrollment_count FROM supplier")
def src13(spark, d):
    n = (F.col("s_suppkey") + 10000000).cast("string")
    mail = F.concat(F.lit("Write to a"), text_of("s_suppkey"), F.lit("@b.org now"))
    trial = tag("trial", F.concat(tag("isrctn", n), tag("trialDescription", tag("title", F.col("s_name"))), tag("plainEnglishSummary", mail), tag("contact", tag("email", mail)), tag("recruitmentCountries", tag("country", "United Kingdom")), tag("targetEnrolment", (F.col("s_suppkey") % 50).cast("string"))))
    return registries.british_trials(spark, files(load(spark, d, "supplier"), tag("fullTrial", trial))).select("source_id", "brief_title", "summary", "countries", "enrollment_count")


_WHO = "SELECT 'CTRI' || s_suppkey AS source_id, s_name AS brief_title, CASE WHEN s_suppkey % 2 = 0 THEN 'NOT_RECRUITING' ELSE 'RECRUITING' END AS status, ['PHASE2', 'PHASE3'] AS phases, ['a', 'b ' || s_nationkey] AS conditions, '2024-01-10' AS last_update_date FROM supplier"
_WHO_COLUMNS = ("source_id", "brief_title", "status", "phases", "conditions", "last_update_date")


def _who(spark: SparkSession, d: str) -> dict[str, Column]:
    status = F.when(F.col("s_suppkey") % 2 == 0, "Not Recruiting").otherwise("Recruiting")
    return {"TrialID": F.concat(F.lit("CTRI"), "s_suppkey"), "Public_title": F.col("s_name"), "Recruitment_status2": status, "Phase": F.lit("2/3"), "Condition": F.concat(F.lit("Condition 1: a; nil; b "), "s_nationkey"), "last_updated": F.lit("10 January 2024")}


@query("src14_who_xml", _WHO)
def src14(spark, d):
    record = tag("trial", tag("Trial", F.concat(*[tag(k, v) for k, v in _who(spark, d).items()])))
    return registries.who_xml(spark, files(load(spark, d, "supplier"), F.concat(F.lit("<?xml version='1.0'?><ICTRP_export>"), record, F.lit("</ICTRP_export>")))).select(*_WHO_COLUMNS)


@query("src15_who_csv", _WHO)
def src15(spark, d):
    name = folder(spark)
    load(spark, d, "supplier").select(*[v.alias(k) for k, v in _who(spark, d).items()]).write.options(header=True).csv(name)
    return registries.who_csv(spark, name).select(*_WHO_COLUMNS)


@query("src16_who_pages", _WHO)
def src16(spark, d):
    label = {"Recruitment_status2": "Recruitment_status", "last_updated": "Last_updated"}
    span = lambda k, i, v: F.concat(F.lit(f'<td><span id="DataList3_ctl{i:02d}_{label.get(k, k)}Label">'), v, F.lit("</span></td>"))
    cells = [span(k, 1, v) for k, v in _who(spark, d).items() if k != "Condition"]
    cells += [span("Condition", 2, F.concat(F.lit("b "), "s_nationkey")), span("Condition", 1, F.lit("a<br>"))]
    return registries.who_pages(load(spark, d, "supplier").select(F.concat(*cells).alias("html")), "html").select(*_WHO_COLUMNS)


@query("src17_drug_priors", "SELECT 'C' || s_suppkey AS source_id, s_name AS name, 'PHASE_' || (1 + s_suppkey % 4) AS clinical_stage, CASE WHEN s_suppkey % 2 = 0 THEN 'T' || s_nationkey END AS symbol FROM supplier")
def src17(spark, d):
    s = load(spark, d, "supplier")
    drug = F.struct(F.concat(F.lit("PHASE_"), (F.col("s_suppkey") % 4 + 1).cast("string")).alias("maxClinicalStage"), F.struct(F.concat(F.lit("C"), "s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("drug"))
    disease = lambda field: F.to_json(F.struct(F.struct(F.struct(F.lit("E1").alias("id"), F.struct(F.col("items").alias("rows")).alias(field)).alias("disease")).alias("data")))
    action = F.struct(F.lit("inhibits").alias("mechanismOfAction"), F.array(F.struct(F.concat(F.lit("T"), "s_nationkey").alias("approvedSymbol"))).alias("targets"))
    known = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("C"), "s_suppkey").alias("id"), F.struct(F.array(action).alias("rows")).alias("mechanismsOfAction")).alias("drug")).alias("data")))
    mechanisms = whole_files(s.where("s_suppkey % 2 = 0"), F.col("s_suppkey"), known)
    found = knowledge.drug_priors(spark, pages(s, "s_suppkey", drug, disease("drugAndClinicalCandidates")), mechanisms)
    return found.select("source_id", "name", "clinical_stage", F.get(F.get("mechanisms", F.lit(0))["targets"], F.lit(0))["symbol"].alias("symbol"))


@query("src17_target_priors", "SELECT 'G' || s_suppkey AS source_id, s_name AS name, s_suppkey / 1000.0::DOUBLE AS score FROM supplier")
def src17b(spark, d):
    row = F.struct((F.col("s_suppkey") / 1000.0).alias("score"), F.struct(F.concat(F.lit("G"), "s_suppkey").alias("id"), F.col("s_name").alias("approvedSymbol")).alias("target"))
    page = F.to_json(F.struct(F.struct(F.struct(F.lit("E1").alias("id"), F.struct(F.col("items").alias("rows")).alias("associatedTargets")).alias("disease")).alias("data")))
    return knowledge.target_priors(spark, pages(load(spark, d, "supplier"), "s_suppkey", row, page)).select("source_id", "name", "score")


_DRUGBANK = "SELECT 'DB' || (10000000 + p_partkey) AS id, p_name AS name, p_type, 'T' || p_size AS target FROM part WHERE p_type LIKE '%LARGE%' OR p_partkey IN (SELECT s_suppkey FROM supplier)"


def _drugs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = (F.col("p_partkey") + 10000000).cast("string")
    record = F.concat(F.lit("<drug type='x'><drugbank-id primary='true'>DB"), key, F.lit("</drugbank-id>"), tag("name", F.concat(F.lit("Drug "), key)), tag("description", F.col("p_type")), tag("targets", tag("target", tag("name", F.concat(F.lit("T"), "p_size")))), F.lit("</drug>"))
    seeds = load(spark, d, "supplier").select(F.concat(F.lit(" DRUG "), (F.col("s_suppkey") + 10000000).cast("string")).alias("name"))
    return knowledge.drug_records(spark, files(load(spark, d, "part"), record), "Large", seeds)


@query("src18_drug_records", f"SELECT id AS source_id, p_type AS description FROM ({_DRUGBANK})")
def src18(spark, d):
    return _drugs(spark, d)[0].select("source_id", "description")


@query("src18_drug_targets", f"SELECT target, min(id) AS first_drug FROM ({_DRUGBANK}) GROUP BY 1")
def src18b(spark, d):
    return _drugs(spark, d)[1]


@query("src19_associations", "SELECT DISTINCT 'S' || p_size || ':rs' || p_partkey AS source_id, p_brand AS mapped_gene, p_size * 1e-9 AS p_value FROM part WHERE p_type LIKE '%PROMO%'")
def src19(spark, d):
    p = load(spark, d, "part")
    t = p.select(F.concat(F.lit("S"), "p_size").alias("STUDY ACCESSION"), F.concat(F.lit("rs"), "p_partkey").alias("SNPS"), F.col("p_type").alias("DISEASE/TRAIT"), F.lit("x").alias("MAPPED_TRAIT"), F.col("p_brand").alias("MAPPED_GENE"), (F.col("p_size") * 1e-9).cast("string").alias("P-VALUE"), F.lit("1.2").alias("OR or BETA"))
    name = folder(spark)
    t.union(t.where("`OR or BETA` = '1.2'")).write.options(header=True, sep="\t").csv(name)
    return knowledge.associations(spark, name, "promo").select("source_id", "mapped_gene", "p_value")


@query("src20_projects", "SELECT c_custkey::VARCHAR AS source_id, c_name AS title, (2000 + c_nationkey)::INTEGER AS fiscal_year, (c_custkey * 10)::INTEGER AS award_amount, c_mktsegment AS organization, ['PI ' || c_nationkey] AS investigators FROM customer")
def src20(spark, d):
    row = F.struct(text_of("c_custkey").alias("appl_id"), F.col("c_name").alias("project_title"), (F.col("c_nationkey") + 2000).alias("fiscal_year"), (F.col("c_custkey") * 10).alias("award_amount"), F.struct(F.col("c_mktsegment").alias("org_name")).alias("organization"), F.array(F.struct(F.concat(F.lit(" PI "), "c_nationkey", F.lit(" ")).alias("full_name"))).alias("principal_investigators"))
    found = knowledge.projects(spark, pages(load(spark, d, "customer"), "c_custkey", row, F.to_json(F.struct(F.col("items").alias("results")))))
    return found.select("source_id", "title", "fiscal_year", "award_amount", "organization", "investigators")


@query("src21_crossref", "SELECT '10.1/p' || p_partkey AS doi, p_name AS title, p_type AS abstract, 1950 + p_size AS year, p_brand AS journal FROM part WHERE p_size % 5 > 0")
def src21(spark, d):
    row = F.struct(F.concat(F.lit(" 10.1/P"), "p_partkey").alias("DOI"), F.when(F.col("p_size") % 5 > 0, F.array("p_name")).otherwise(F.array(F.lit(" "))).alias("title"), F.concat(F.lit("<jats:p>"), "p_type", F.lit("</jats:p>")).alias("abstract"), F.array("p_brand").alias("container-title"), F.struct(F.array(F.array(F.col("p_size") + 1950, F.lit(2))).alias("date-parts")).alias("issued"))
    page = F.to_json(F.struct(F.struct("items").alias("message")))
    return literature.crossref(spark, pages(load(spark, d, "part"), "p_partkey", row, page)).select("doi", "title", "abstract", "year", "journal")


def _annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    size = text_of("p_size")
    infons = lambda **v: F.struct(*[x.alias(k) for k, x in v.items()])
    mention = F.struct(infons(type=F.lit("Gene"), identifier=F.when(F.col("p_size") % 4 > 0, size)).alias("infons"), F.col("p_brand").alias("text"), F.array(F.struct(F.lit(100).alias("offset"), F.length("p_brand").alias("length"))).alias("locations"))
    passage = F.struct(infons(type=F.lit("title")).alias("infons"), F.lit(100).alias("offset"), F.concat("p_brand", F.lit(" is "), "p_type").alias("text"), F.array(mention).alias("annotations"))
    relation = F.struct(infons(type=F.lit("Association"), score=F.when(F.col("p_size") % 2 == 0, F.lit("0.5")).otherwise("n/a"), role1=infons(identifier=size), role2=infons(identifier=F.when(F.col("p_size") % 3 > 0, F.lit("D1")))).alias("infons"))
    row = F.struct(text_of("p_partkey").alias("pmid"), F.array(passage).alias("passages"), F.array(relation).alias("relations"))
    return literature.annotations(spark, pages(load(spark, d, "part"), "p_partkey", row, F.to_json(F.struct(F.col("items").alias("PubTator3")))))


@query("src22_mentions", "SELECT p_partkey::VARCHAR AS pmid, p_size::VARCHAR AS identifier, p_brand AS text, 100 AS offset, left(' is ' || p_type, 24) AS after FROM part WHERE p_size % 4 > 0")
def src22(spark, d):
    return _annotated(spark, d)[0].select("pmid", "identifier", "text", "offset", "after")


@query("src22_relations", "SELECT p_partkey::VARCHAR AS pmid, CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS score, p_size::VARCHAR AS first, 'D1' AS second FROM part WHERE p_size % 3 > 0")
def src22b(spark, d):
    return _annotated(spark, d)[1].select("pmid", "score", "first", "second")


@query("src23_headings", "SELECT 'D' || p_partkey AS id, p_name AS name, [p_brand, p_type] AS terms FROM part WHERE p_partkey IN (SELECT s_suppkey * 2 FROM supplier)")
def src23(spark, d):
    term = lambda v: tag("Term", tag("String", v))
    record = tag("DescriptorRecord", F.concat(tag("DescriptorUI", F.concat(F.lit("D"), "p_partkey")), tag("DescriptorName", tag("String", F.col("p_name"))), tag("TermList", F.concat(term(F.col("p_brand")), term(F.col("p_type"))))))
    wanted = load(spark, d, "supplier").select(F.concat(F.lit("D"), (F.col("s_suppkey") * 2).cast("string")).alias("id"))
    return literature.headings(spark, files(load(spark, d, "part"), record), wanted).select("id", "name", "terms")


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = text_of("p_partkey")
    lines = F.concat_ws("\n", F.concat(k, F.lit("|t|"), "p_name"), F.concat(k, F.lit("|a|"), "p_type"), F.concat_ws("\t", k, F.lit("0"), F.length("p_name").cast("string"), F.col("p_name"), F.lit("Disease"), F.concat(F.lit("D"), "p_size")), F.concat_ws("\t", k, F.lit("CID"), F.concat(F.lit("D"), "p_size"), F.lit("D0")))
    return literature.gold_lines(spark, files(load(spark, d, "part"), lines))


@query("src24_gold_passages", "SELECT p_partkey::VARCHAR AS id, 't' AS kind, p_name AS text FROM part UNION ALL SELECT p_partkey::VARCHAR, 'a', p_type FROM part")
def src24(spark, d):
    return _gold(spark, d)[0]


@query("src24_gold_mentions", "SELECT p_partkey::VARCHAR AS id, 0 AS start, len(p_name)::INTEGER AS \"end\", p_name AS text, 'D' || p_size AS concept FROM part")
def src24b(spark, d):
    return _gold(spark, d)[1].select("id", "start", "end", "text", "concept")


@query("src24_gold_relations", "SELECT p_partkey::VARCHAR AS id, 'CID' AS relation, 'D' || p_size AS first, 'D0' AS second FROM part")
def src24c(spark, d):
    return _gold(spark, d)[2]


@query("src24_gold_tables", "SELECT p_partkey::VARCHAR AS id, p_brand AS first, p_type AS second, 'CPR:' || p_size AS relation FROM part")
def src24d(spark, d):
    k = text_of("p_partkey")
    entities = load(spark, d, "part").select(F.explode(F.array(F.concat_ws("\t", k, F.lit("T1"), F.lit("CHEMICAL"), F.lit("0"), F.lit("4"), F.col("p_brand")), F.concat_ws("\t", k, F.lit("T2"), F.lit("GENE"), F.lit("5"), F.lit("9"), F.col("p_type")))).alias("v"))
    relations = F.concat_ws("\t", k, F.concat(F.lit("CPR:"), "p_size"), F.lit("Arg1:T1"), F.lit("Arg2:T2"))
    return literature.gold_tables(spark, files(entities, F.col("v")), files(load(spark, d, "part"), relations)).select("id", "first", "second", "relation")


@query("src28_sparse_counts", "SELECT 'G' || (1 + s_nationkey % 5) AS gene, 'C' || s_suppkey AS cell, 7 + s_suppkey AS n FROM supplier")
def src28(spark, d):
    s = load(spark, d, "supplier")
    n = s.count()
    entries = s.groupBy(F.lit(1).alias("one")).agg(F.array_join(F.collect_list(F.concat_ws(" ", (F.col("s_nationkey") % 5 + 1).cast("string"), (F.col("s_suppkey") - s.agg(F.min("s_suppkey")).scalar() + 1).cast("string"), (F.col("s_suppkey") + 7).cast("string"))), "\n").alias("b"))
    matrix = whole_files(entries, F.col("one"), F.concat(F.lit(f"%%MatrixMarket matrix coordinate integer general\n5 {n} {n}\n"), "b"))
    genes = whole_files(spark.range(1), F.col("id"), F.lit("\n".join(f"G{i}\tx" for i in range(1, 6))))
    cells = whole_files(s.groupBy(F.lit(1).alias("one")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: F.concat(F.lit("C"), x)), "\n").alias("b")), F.col("one"), F.col("b"))
    return knowledge.sparse_counts(spark, matrix + "/file=1", genes + "/file=0", cells + "/file=1")


@query("src28_pseudobulk", "SELECT 'donor' || (l_suppkey % 4) AS donor, 'G' || (l_partkey % 6) AS gene, sum(l_linenumber)::BIGINT AS n, count(DISTINCT l_suppkey) AS cells FROM lineitem GROUP BY 1, 2")
def src28b(spark, d):
    l = load(spark, d, "lineitem")
    counts = l.groupBy(F.concat(F.lit("G"), (F.col("l_partkey") % 6).cast("string")).alias("gene"), F.col("l_suppkey").alias("cell")).agg(F.sum("l_linenumber").alias("n"))
    donors = l.select(F.col("l_suppkey").alias("cell")).distinct().withColumn("donor", F.concat(F.lit("donor"), (F.col("cell") % 4).cast("string")))
    return knowledge.pseudobulk(counts, donors, "donor")


@query("src29_curation", "SELECT s_suppkey AS id, s_name AS name, [s_nationkey, 1] AS refs FROM supplier")
def src29(spark, d):
    record = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array("s_nationkey", F.lit(1)).alias("refs")))
    return knowledge.curation(spark, files(load(spark, d, "supplier"), record), "id long, name string, refs array<int>", lines=True)


@query("src29_curation_arrays", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def src29b(spark, d):
    record = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return knowledge.curation(spark, pages(load(spark, d, "supplier"), "s_suppkey", record, F.to_json("items")), "id long, name string").select("id", "name")


@query("src30_table_scan", "SELECT p_brand, count(*) AS n, list_sort(list(p_retailprice)) AS prices FROM part GROUP BY 1")
def src30(spark, d):
    """A column of a raw table as arrays, one a group."""
    return load(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("p_retailprice")).alias("prices"))


def _store(spark: SparkSession) -> sinks.Store:
    return sinks.Store(spark, folder(spark))


@query("k02_trial_upsert", "SELECT 'NCT' || s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS brief_title, ['South Korea', 'United States'] AS countries FROM supplier")
def k02(spark, d):
    s = load(spark, d, "supplier")
    rows = lambda keep, title: common.conform(s.where(keep).select(F.lit("ctgov").alias("source"), F.concat(F.lit("NCT"), "s_suppkey").alias("source_id"), F.lit(title).alias("brief_title"), F.array(F.lit("USA"), F.lit("Korea, Republic of"), F.lit("Worldwide")).alias("countries")), "trials")
    store = _store(spark)
    store.ingest("trials", sinks.canonical_countries(rows("true", "old")), "ctgov", "q")
    store.ingest("trials", sinks.canonical_countries(rows("s_suppkey % 2 = 0", "new")), "ctgov", "q")
    return store.read("trials").select("source_id", "brief_title", F.array_sort("countries").alias("countries"))


@query("k03_prior_upsert", "SELECT 'drug' AS kind, 'C' || s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS score FROM supplier")
def k03(spark, d):
    s = load(spark, d, "supplier")
    rows = lambda keep, score: common.conform(s.where(keep).select(F.lit("opentargets").alias("source"), F.lit("drug").alias("kind"), F.concat(F.lit("C"), "s_suppkey").alias("source_id"), F.lit("E1").alias("disease_id"), F.lit(score).alias("score")), "priors")
    store = _store(spark)
    store.upsert("priors", rows("true", 0.1))
    store.upsert("priors", rows("s_suppkey % 3 = 0", 0.9))
    return store.read("priors").select("kind", "source_id", "score")


@query("k04_run_audit", "SELECT 'completed' AS status, (SELECT count(*) FROM supplier) AS fetched, (SELECT count(*) FROM supplier) AS inserted, 0::BIGINT AS updated UNION ALL SELECT 'completed', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0), 0, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT 'failed', NULL, NULL, NULL")
def k04(spark, d):
    s = load(spark, d, "supplier")
    rows = lambda keep: common.conform(s.where(keep).select(F.lit("a").alias("source"), text_of("s_suppkey").alias("source_id"), F.col("s_name").alias("title")), "documents")
    store = _store(spark)
    store.ingest("documents", rows("true"), "a", "q")
    store.ingest("documents", rows("s_suppkey % 2 = 0"), "a", "q")
    try:
        store.ingest("documents", rows("raise_error('no payload') IS NULL"), "a", "broken")
    except Exception as e:
        if "no payload" not in str(e):
            raise
    return store.runs().select("status", "fetched", "inserted", "updated")


@query("k05_snapshot_files", "SELECT n_name AS subject, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey")
def k05b(spark, d):
    name = folder(spark)
    sinks.graph_snapshot(load(spark, d, "nation").select(F.lit("place").alias("kind"), F.col("n_name").alias("name")), _edges(spark, d), name)
    return spark.read.json(f"{name}/edges").select("subject", "object")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return load(spark, d, "nation").join(r, "n_regionkey").select(F.col("n_name").alias("subject"), F.lit("in").alias("predicate"), F.col("r_name").alias("object"), (F.col("n_nationkey") / 30.0).alias("confidence"), F.array(F.col("n_name"), F.lit("x")).alias("evidence"))


@query("k06_licensed_release", "SELECT CASE WHEN s_nationkey % 3 = 0 THEN 'restricted' ELSE 'main' END AS part, s_suppkey, s_name FROM supplier")
def k06(spark, d):
    name = folder(spark)
    s = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sinks.licensed_release({"suppliers": s}, F.col("s_nationkey") % 3 == 0, name)
    parts = [spark.read.json(f"{name}/{part}/suppliers").select(F.lit(part).alias("part"), "s_suppkey", "s_name") for part in ("main", "restricted")]
    return parts[0].union(parts[1])


@query("k07_flat_csv", "SELECT n_name AS subject, n_name || ';x' AS evidence FROM nation")
def k07(spark, d):
    name = folder(spark)
    sinks.flat_csv(_edges(spark, d), name)
    return spark.read.option("header", True).csv(name).select("subject", "evidence")


@query("k08_triples_file", "SELECT n_name AS subject, 'in' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey")
def k08b(spark, d):
    name = folder(spark)
    sinks.triples_tsv(_edges(spark, d), name)
    return spark.read.option("sep", "\t").csv(name).toDF("subject", "predicate", "object")


@query("k09_differential", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey >= 2")
def k09(spark, d):
    name = folder(spark)
    sinks.differential_jsonl(load(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("n_case"), F.lit(2).alias("n_control")), name)
    return spark.read.schema("s_suppkey long, s_acctbal double").json(name)


@query("k10_markdown", "SELECT '| ' || n_name || ' | ' || n_nationkey || ' |' AS line FROM nation UNION ALL SELECT '| name | key |' UNION ALL SELECT '|---|---|'")
def k10(spark, d):
    body = sinks.markdown(load(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))
    return spark.createDataFrame([(x,) for x in body.splitlines()], "line string")


@query("k11_seals", "SELECT n_nationkey, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS sha256, TRUE AS verified FROM nation")
def k11(spark, d):
    from tessera.operators import ledger

    rows = load(spark, d, "nation").select("n_nationkey", "n_name").collect()  # a record each of a small reference table
    sealed = [(r.n_nationkey, {"name": r.n_name, "key": r.n_nationkey}) for r in rows]
    return spark.createDataFrame([(k, sinks.seal_json(x)[1], ledger.verify_seal(ledger.sealed(x))) for k, x in sealed], "n_nationkey int, sha256 string, verified boolean")
