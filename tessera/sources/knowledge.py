"""Knowledge sources: target-disease platforms, drug records, genetics, funding, curation, expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.common import conform, delimited, json_documents, json_lines, many, one, xml_records

DRUGS = "data struct<disease:struct<id:string,name:string,drugAndClinicalCandidates:struct<rows:array<struct<maxClinicalStage:string,drug:struct<id:string,name:string,synonyms:array<string>>>>>,associatedTargets:struct<rows:array<struct<score:double,target:struct<id:string,approvedSymbol:string,approvedName:string>>>>>>"
MECHANISMS = "data struct<drug:struct<id:string,mechanismsOfAction:struct<rows:array<struct<mechanismOfAction:string,actionType:string,targetName:string,targets:array<struct<id:string,approvedSymbol:string,approvedName:string>>>>>>>"


def drug_priors(spark: SparkSession, path: str, mechanisms: str) -> DataFrame:
    """Clinical candidates of a disease with their mechanisms of action."""
    d = json_documents(spark, path, DRUGS).select(F.col("data.disease.id").alias("disease_id"), F.explode("data.disease.drugAndClinicalCandidates.rows").alias("r"))
    m = json_documents(spark, mechanisms, MECHANISMS).select(F.col("data.drug.id").alias("source_id"), F.transform("data.drug.mechanismsOfAction.rows", lambda x: F.struct(x["mechanismOfAction"].alias("mechanism"), x["actionType"].alias("action_type"), x["targetName"].alias("target_name"), F.transform(x["targets"], lambda t: F.struct(t["id"].alias("id"), t["approvedSymbol"].alias("symbol"), t["approvedName"].alias("name"))).alias("targets"))).alias("mechanisms"))
    rows = d.select(F.lit("opentargets").alias("source"), F.lit("drug").alias("kind"), F.col("r.drug.id").alias("source_id"), "disease_id", F.col("r.drug.name").alias("name"), F.col("r.maxClinicalStage").alias("clinical_stage"), F.col("r.drug.synonyms").alias("synonyms"))
    return conform(rows.join(m, "source_id", "left"), "priors")


def target_priors(spark: SparkSession, path: str) -> DataFrame:
    d = json_documents(spark, path, DRUGS).select(F.col("data.disease.id").alias("disease_id"), F.explode("data.disease.associatedTargets.rows").alias("r"))
    return conform(d.select(F.lit("opentargets").alias("source"), F.lit("target").alias("kind"), F.col("r.target.id").alias("source_id"), "disease_id", F.col("r.target.approvedSymbol").alias("name"), F.col("r.target.approvedName").alias("description"), F.col("r.score").alias("score")), "priors")


def drug_records(spark: SparkSession, path: str, topic: str, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drug records that mention the topic or bear a seed name (name), and their targets, each by the first drug that has it."""
    x = F.col("xml")
    rows = xml_records(spark, path, "drug").select(
        F.coalesce(one(x, "/drug/drugbank-id[@primary='true']"), one(x, "/drug/drugbank-id")).alias("source_id"), one(x, "/drug/name").alias("name"), one(x, "/drug/description").alias("description"), many(x, "/drug/synonyms/synonym").alias("synonyms"), many(x, "/drug/groups/group").alias("groups"),
        many(x, "/drug/targets/target/name").alias("targets"), F.contains(F.lower(x), F.lit(topic.lower())).alias("mentions"),
    ).where("source_id IS NOT NULL")
    wanted = seeds.select(F.lower(F.trim("name")).alias("n")).distinct()
    named = rows.select("source_id", F.explode(F.transform(F.concat(F.array("name"), "synonyms"), lambda n: F.lower(F.trim(n)))).alias("n")).join(wanted, "n", "left_semi").select("source_id").distinct().withColumn("named", F.lit(True))
    kept = rows.join(named, "source_id", "left").where("mentions OR named")
    drugs = conform(kept.select(F.lit("drugbank").alias("source"), F.lit("drug").alias("kind"), "source_id", F.lit("").alias("disease_id"), "name", "description", F.when(F.array_contains("groups", "approved"), "APPROVAL").alias("clinical_stage"), "synonyms"), "priors")
    targets = kept.select("source_id", F.explode("targets").alias("target")).groupBy("target").agg(F.min("source_id").alias("first_drug"))
    return drugs, targets


ASSOCIATION_COLUMNS = ("STUDY ACCESSION", "SNPS", "DISEASE/TRAIT", "MAPPED_TRAIT", "MAPPED_GENE", "P-VALUE", "OR or BETA")


def associations(spark: SparkSession, path: str, trait: str) -> DataFrame:
    """Genetic associations of a trait; the first of equal identities stays."""
    t = delimited(spark, path, "\t", ASSOCIATION_COLUMNS)
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in t.columns else F.lit(None).cast("string")
    hit = F.contains(F.lower(F.concat_ws(" ", F.col("`DISEASE/TRAIT`"), F.col("MAPPED_TRAIT"))), F.lit(trait.lower()))
    rows = t.where(hit).select(
        F.lit("gwas_catalog").alias("source"), F.concat_ws(":", text("STUDY ACCESSION"), text("SNPS")).alias("source_id"), text("DISEASE/TRAIT").alias("trait"), text("MAPPED_TRAIT").alias("mapped_trait"), text("SNPS").alias("variant"), text("MAPPED_GENE").alias("mapped_gene"), text("REPORTED GENE(S)").alias("reported_genes"),
        text("STRONGEST SNP-RISK ALLELE").alias("risk_allele"), text("P-VALUE").try_cast("double").alias("p_value"), text("P-VALUE").alias("p_value_text"), text("OR or BETA").try_cast("double").alias("odds_ratio_or_beta"), text("95% CI (TEXT)").alias("confidence_interval"), text("STUDY ACCESSION").alias("study_accession"), text("PUBMEDID").alias("pubmed_id"),
    )
    known = rows.where("study_accession IS NOT NULL AND variant IS NOT NULL")
    return conform(known.dropDuplicates(["source", "source_id"]), "genetic_associations")


PROJECTS = "results array<struct<appl_id:string,project_title:string,fiscal_year:int,award_amount:int,is_active:boolean,contact_pi_name:string,organization:struct<org_name:string>,terms:string,principal_investigators:array<struct<full_name:string>>>>"


def projects(spark: SparkSession, path: str) -> DataFrame:
    r = json_documents(spark, path, PROJECTS).select(F.explode("results").alias("r")).select("r.*")
    return conform(r.select(F.lit("nih_reporter").alias("source"), F.col("appl_id").alias("source_id"), F.col("project_title").alias("title"), "fiscal_year", "award_amount", "is_active", F.col("contact_pi_name").alias("contact_pi"), F.col("organization.org_name").alias("organization"), "terms", F.transform("principal_investigators", lambda p: F.trim(p["full_name"])).alias("investigators")), "research_projects")


def licences(spark: SparkSession, path: str) -> DataFrame:
    """Cached licence table (pmcid, licence)."""
    t = delimited(spark, path, ",", ("Accession ID", "License"))
    return t.select(F.col("Accession ID").alias("pmcid"), F.col("License").alias("licence")).dropDuplicates(["pmcid"])


def curation(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Curated records, one JSON array a file or one record a line."""
    return json_lines(spark, path, schema) if lines else json_documents(spark, path, schema)


def series_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of series-matrix headers: (series_file, sample, title, source_name, organism, characteristics)."""
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("f")).where(F.startswith("value", F.lit("!Sample_")))
    cells = lines.select("f", F.split_part("value", F.lit("\t"), F.lit(1)).alias("field"), F.xxhash64("value").alias("row"), F.posexplode(F.transform(F.slice(F.split("value", "\t"), 2, 1_000_000), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))).alias("col", "v"))
    fixed = {"!Sample_geo_accession": "sample", "!Sample_title": "title", "!Sample_source_name_ch1": "source_name", "!Sample_organism_ch1": "organism"}
    wide = cells.groupBy("f", "col").agg(*[F.max(F.when(F.col("field") == k, F.col("v"))).alias(n) for k, n in fixed.items()])
    key, value = F.lower(F.trim(F.split_part("v", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("v", r"^[^:]*:", ""))
    ch = cells.where((F.col("field") == "!Sample_characteristics_ch1") & F.contains("v", F.lit(":"))).select("f", "col", key.alias("k"), value.alias("x")).where("k <> '' AND x <> ''")
    maps = ch.groupBy("f", "col", "k").agg(F.max("x").alias("x")).groupBy("f", "col").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "x")))).alias("characteristics"))
    return wide.where("sample IS NOT NULL").join(maps, ["f", "col"], "left").select(F.col("f").alias("series_file"), *fixed.values(), "characteristics")


def expression_values(spark: SparkSession, path: str) -> DataFrame:
    """A series matrix in long form (probe, sample, value); header lines start with ``!``."""
    wide = spark.read.options(header=True, sep="\t", comment="!", quote='"').csv(path)
    first, *samples = wide.columns
    return wide.unpivot([first], samples, "sample", "value").select(F.col(first).alias("probe"), "sample", F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")


def probe_genes(spark: SparkSession, path: str, probe: str = "ID", gene: str = "Gene symbol") -> DataFrame:
    """Platform annotation; probes of several genes are left out."""
    t = delimited(spark, path, "\t", (probe, gene), comment="#")
    return t.select(F.col(f"`{probe}`").alias("probe"), F.trim(F.col(f"`{gene}`")).alias("gene")).where("gene <> '' AND NOT contains(gene, '///')")


def sparse_counts(spark: SparkSession, matrix: str, genes: str, cells: str) -> DataFrame:
    """A matrix-market file with its gene and cell lists as (gene, cell, n)."""
    number = lambda path, name: spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("i")).withColumn("n", F.row_number().over(Window.orderBy("i"))).select("n", F.split_part("value", F.lit("\t"), F.lit(1)).alias(name))
    rows = spark.read.text(matrix).where(~F.startswith("value", F.lit("%"))).select(F.split("value", " ").alias("c")).select(*[F.get("c", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("g", "k", "n"))])
    # The first line states the size: its third number is the number of entries, not a count of a gene.
    shape = spark.read.text(matrix).where(~F.startswith("value", F.lit("%"))).first()[0].split()
    rows = rows.where(~((F.col("g") == int(shape[0])) & (F.col("k") == int(shape[1])) & (F.col("n") == int(shape[2]))))
    return rows.join(number(genes, "gene").withColumnRenamed("n", "g"), "g").join(number(cells, "cell").withColumnRenamed("n", "k"), "k").select("gene", "cell", "n")


def gene_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of genes (name, symbol): identifiers, current and previous symbols; a current symbol is no other gene's old one."""
    t = delimited(spark, path, "\t", ("hgnc_id", "symbol", "prev_symbol"))
    old = F.filter(F.transform(F.split(F.coalesce("prev_symbol", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    names = t.select(F.col("hgnc_id").alias("name"), "symbol").union(t.select(F.explode(old).alias("name"), "symbol").join(t.select(F.col("symbol").alias("name")), "name", "left_anti"))
    return names.groupBy("name").agg(F.min("symbol").alias("symbol"))


def pseudobulk(counts: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """Counts (gene, cell, n) summed over the cells of each group: rows (group, gene, n, cells)."""
    return counts.join(cells, "cell").groupBy(group, "gene").agg(F.sum("n").alias("n"), F.countDistinct("cell").alias("cells"))
