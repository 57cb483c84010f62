"""Trial registries: payload records to rows of the trials table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import bare_phases, country_list, iso_date, redact, registry_status, strip_label, study_type
from tessera.sources.common import conform, delimited, json_documents, many, one, xml_records

_DATE = "struct<date:string>"
STUDIES = (
    "studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string,secondaryIdInfos:array<struct<id:string>>>,"
    f"statusModule:struct<overallStatus:string,startDateStruct:{_DATE},completionDateStruct:{_DATE},studyFirstPostDateStruct:{_DATE},lastUpdatePostDateStruct:{_DATE}>,"
    "descriptionModule:struct<briefSummary:string>,conditionsModule:struct<conditions:array<string>,keywords:array<string>>,designModule:struct<studyType:string,phases:array<string>,enrollmentInfo:struct<count:int>>,"
    "armsInterventionsModule:struct<interventions:array<struct<type:string,name:string,description:string,otherNames:array<string>>>>,"
    "outcomesModule:struct<primaryOutcomes:array<struct<measure:string,description:string,timeFrame:string>>,secondaryOutcomes:array<struct<measure:string,description:string,timeFrame:string>>>,"
    "eligibilityModule:struct<sex:string,minimumAge:string,maximumAge:string,healthyVolunteers:boolean>,contactsLocationsModule:struct<locations:array<struct<facility:string,city:string,country:string>>>,"
    "sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>,collaborators:array<struct<name:string>>>>,hasResults:boolean>>"
)


def clinical_trials(spark: SparkSession, path: str) -> DataFrame:
    """Version 2 study documents of the American registry."""
    s = json_documents(spark, path, STUDIES).select(F.explode("studies").alias("s")).select(F.col("s.protocolSection").alias("p"), F.col("s.hasResults").alias("r"), F.to_json("s").alias("raw_metadata"))
    s = s.where(F.trim(F.coalesce("p.identificationModule.nctId", F.lit(""))) != "")
    p = lambda path: F.col(f"p.{path}")
    outcomes = lambda c: F.transform(c, lambda o: F.struct(o["measure"].alias("measure"), o["description"].alias("description"), o["timeFrame"].alias("time_frame")))
    none = F.array().cast("array<string>")
    sponsors = F.concat(F.array_compact(F.array(p("sponsorCollaboratorsModule.leadSponsor.name"))), F.coalesce(F.transform(p("sponsorCollaboratorsModule.collaborators"), lambda c: c["name"]), none))
    places = F.coalesce(F.transform(p("contactsLocationsModule.locations"), lambda x: F.trim(x["country"])), none)
    rows = s.select(
        F.lit("ctgov").alias("source"), F.trim(p("identificationModule.nctId")).alias("source_id"), p("identificationModule.briefTitle").alias("brief_title"), p("identificationModule.officialTitle").alias("official_title"),
        F.nullif(F.trim(p("descriptionModule.briefSummary")), F.lit("")).alias("summary"), p("statusModule.overallStatus").alias("status"), p("designModule.studyType").alias("study_type"),
        F.coalesce(p("designModule.phases"), none).alias("phases"), F.coalesce(p("conditionsModule.conditions"), none).alias("conditions"), F.coalesce(p("conditionsModule.keywords"), none).alias("keywords"),
        F.transform(p("armsInterventionsModule.interventions"), lambda i: F.struct(i["type"].alias("type"), i["name"].alias("name"), i["description"].alias("description"), i["otherNames"].alias("other_names"))).alias("interventions"),
        sponsors.alias("sponsors"), F.transform(p("contactsLocationsModule.locations"), lambda x: F.struct(x["country"].alias("country"), x["city"].alias("city"), x["facility"].alias("facility"))).alias("locations"),
        F.array_sort(F.array_distinct(F.filter(places, lambda c: c.isNotNull() & (c != "")))).alias("countries"), outcomes(p("outcomesModule.primaryOutcomes")).alias("primary_outcomes"), outcomes(p("outcomesModule.secondaryOutcomes")).alias("secondary_outcomes"),
        p("designModule.enrollmentInfo.count").alias("enrollment_count"), p("eligibilityModule.sex").alias("sex"), p("eligibilityModule.minimumAge").alias("minimum_age"), p("eligibilityModule.maximumAge").alias("maximum_age"), p("eligibilityModule.healthyVolunteers").alias("healthy_volunteers"),
        p("statusModule.startDateStruct.date").alias("start_date"), p("statusModule.completionDateStruct.date").alias("completion_date"), p("statusModule.studyFirstPostDateStruct.date").alias("first_posted_date"), p("statusModule.lastUpdatePostDateStruct.date").alias("last_update_date"),
        F.coalesce("r", F.lit(False)).alias("has_results"), "raw_metadata",
    )
    return conform(rows, "trials")


SEARCH = "data array<struct<ctNumber:string,ctStatus:int,ctTitle:string,shortTitle:string,conditions:string,trialCountries:array<string>,trialPhase:string,therapeuticAreas:array<string>,primaryEndPoint:string,endPoint:string,totalNumberEnrolled:string,gender:string,startDateEU:string,decisionDateOverall:string,lastUpdated:string,resultsFirstReceived:string,sponsor:string>>"


def european_trials(spark: SparkSession, path: str, statuses: dict[int, str]) -> DataFrame:
    """Search pages of the European registry; statuses names its numeric codes."""
    d = json_documents(spark, path, SEARCH).select(F.explode("data").alias("d")).select("d.*").where("trim(ctNumber) <> ''")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    codes = F.create_map(*[F.lit(x) for pair in statuses.items() for x in pair])
    outcome = lambda c: F.when(text(c).isNotNull(), F.array(F.struct(text(c).alias("measure"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("time_frame"))))
    phases = F.regexp_extract_all(F.lower("trialPhase"), F.lit(r"phase\s+(i{1,3}v?|iv|[1-4])"), F.lit(1))
    rows = d.select(
        F.lit("euctr").alias("source"), F.trim("ctNumber").alias("source_id"), F.coalesce(text("shortTitle"), text("ctTitle")).alias("brief_title"), text("ctTitle").alias("official_title"), text("ctTitle").alias("summary"),
        F.try_element_at(codes, F.col("ctStatus")).alias("status"), F.lit("INTERVENTIONAL").alias("study_type"), F.transform(phases, lambda x: F.concat(F.lit("PHASE"), F.when(x.rlike("[1-4]"), x).when(x == "iv", "4").otherwise(F.length(x).cast("string")))).alias("phases"),
        F.filter(F.transform(F.split("conditions", r"\s*[,;]\s*"), lambda x: F.trim(x)), lambda x: x != "").alias("conditions"), F.col("therapeuticAreas").alias("keywords"), country_list(F.col("trialCountries")).alias("countries"),
        outcome(F.col("primaryEndPoint")).alias("primary_outcomes"), outcome(F.col("endPoint")).alias("secondary_outcomes"), F.col("totalNumberEnrolled").try_cast("int").alias("enrollment_count"), text("gender").alias("sex"),
        F.array_compact(F.array(text("sponsor"))).alias("sponsors"), iso_date(F.col("startDateEU")).alias("start_date"), iso_date(F.col("decisionDateOverall")).alias("first_posted_date"), iso_date(F.col("lastUpdated")).alias("last_update_date"), (F.lower("resultsFirstReceived") == "yes").alias("has_results"),
    )
    return conform(rows.withColumn("has_results", F.coalesce("has_results", F.lit(False))), "trials")


def british_trials(spark: SparkSession, path: str) -> DataFrame:
    """Full records of the ISRCTN registry; contacts are never read, addresses in prose are redacted."""
    x = F.col("xml")
    rows = xml_records(spark, path, "fullTrial")
    t = lambda p: one(x, f"//{p}")
    out = rows.select(
        F.lit("isrctn").alias("source"), F.concat(F.lit("ISRCTN"), F.regexp_replace(t("isrctn"), "^ISRCTN", "")).alias("source_id"), t("trialDescription/title").alias("brief_title"), t("trialDescription/scientificTitle").alias("official_title"), redact(t("plainEnglishSummary")).alias("summary"),
        F.upper(t("overallStatus")).alias("status"), F.upper(t("primaryStudyDesign")).alias("study_type"), F.array_compact(F.array(t("intervention/phase"))).alias("phases"), many(x, "//conditions/condition/description").alias("conditions"), many(x, "//recruitmentCountries/country").alias("countries"),
        t("targetEnrolment").try_cast("int").alias("enrollment_count"), t("gender").alias("sex"), t("lowerAgeLimit").alias("minimum_age"), t("upperAgeLimit").alias("maximum_age"), (t("healthyVolunteersAllowed") == "true").alias("healthy_volunteers"),
        F.substring(t("recruitmentStart"), 1, 10).alias("start_date"), F.substring(t("overallEndDate"), 1, 10).alias("completion_date"), (F.size(many(x, "//publicationDetails")) > 0).alias("has_results"),
    )
    return conform(out.where("source_id IS NOT NULL"), "trials")


# Registry statuses in their common form.
STATUSES = {"recruiting": "RECRUITING", "not recruiting": "NOT_RECRUITING", "completed": "COMPLETED", "terminated": "TERMINATED", "withdrawn": "WITHDRAWN", "pending": "NOT_YET_RECRUITING", "authorised": "AUTHORISED"}


def day(raw: Column) -> Column:
    """Dates as registries print them: 15/03/2023, 29-05-2017, 10 January 2024."""
    return F.coalesce(F.date_format(F.try_to_date(F.trim(raw), "d MMMM yyyy"), "yyyy-MM-dd"), iso_date(raw))


def _who_row(get) -> list[Column]:
    parts = lambda c: F.filter(F.transform(F.split(get(c), r"\s*[;|]\s*"), lambda v: strip_label(v)), lambda v: ~F.lower(v).isin("", "nil", "none", "n/a", "na", "not applicable"))
    return [
        F.lit("ictrp").alias("source"), get("TrialID").alias("source_id"), get("Public_title").alias("brief_title"), get("Scientific_title").alias("official_title"), registry_status(get("Recruitment_status2"), STATUSES).alias("status"),
        study_type(get("Study_type")).alias("study_type"), bare_phases(get("Phase")).alias("phases"), F.array_distinct(parts("Condition")).alias("conditions"), parts("Countries").alias("countries"), get("Target_size").try_cast("int").alias("enrollment_count"),
        F.array_compact(F.array(get("Primary_sponsor"))).alias("sponsors"), F.transform(parts("Intervention"), lambda v: F.struct(F.lit(None).cast("string").alias("type"), v.alias("name"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("other_names"))).alias("interventions"),
        day(get("Date_registration2")).alias("first_posted_date"), day(get("Date_enrollement")).alias("start_date"), day(get("last_updated")).alias("last_update_date"), F.lit(False).alias("has_results"),
    ]


def who_xml(spark: SparkSession, path: str) -> DataFrame:
    """WHO portal export in XML, any number of documents in a file."""
    rows = xml_records(spark, path, "Trial")
    return conform(rows.select(*_who_row(lambda c: one(F.col("xml"), f"//{c}"))).where("source_id IS NOT NULL"), "trials")


def who_csv(spark: SparkSession, path: str) -> DataFrame:
    """WHO portal export in CSV; cells with several values are split."""
    rows = delimited(spark, path, ",", ("TrialID",), multiLine=True, escape='"')
    have = {c.lower(): c for c in rows.columns}
    get = lambda c: F.nullif(F.trim(F.col(have[c.lower()])), F.lit("")) if c.lower() in have else F.lit(None).cast("string")
    return conform(rows.select(*_who_row(get)).where("source_id IS NOT NULL"), "trials")


def page_fields(html: Column) -> Column:
    """Labelled fields of a WHO record page: an array of (field, row, value)."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)<span id="DataList\d+_ctl\d+_\w+?Label">.*?</span>'), F.lit(0))
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?i)<br\s*/?>", " "), "<[^>]*>", ""), r"\s+", " "))
    return F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"_ctl\d+_(\w+?)Label", 1).alias("field"), F.regexp_extract(s, r"_ctl(\d+)_", 1).cast("int").alias("row"), clean(F.regexp_extract(s, r"(?s)>(.*)</span>", 1)).alias("value")))


def who_pages(pages: DataFrame, html: str) -> DataFrame:
    """WHO record pages (html) as trials; repeated fields are joined in row order."""
    fields = pages.select(F.explode(page_fields(F.col(html))).alias("f"), F.xxhash64(html).alias("page")).select("page", "f.*").where("value <> ''")
    wide = fields.groupBy("page", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]), "; ").alias("value"))
    maps = wide.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    names = {"Date_registration2": "Date_registration", "last_updated": "Last_updated", "Recruitment_status2": "Recruitment_status"}
    get = lambda c: redact(F.try_element_at("m", F.lit(names.get(c, c))))
    return conform(maps.select(*_who_row(get)).where("source_id IS NOT NULL"), "trials")


def redacted_export(rows: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """An export as it may be cached: only the named columns that it has, each without contact details in its prose."""
    return rows.select(*[redact(F.col(f"`{c}`").cast("string")).alias(c) for c in kept if c in rows.columns])


def strip_personal(html: Column, grids: tuple[str, ...]) -> Column:
    """A record page without its grids of persons, and without contact details elsewhere."""
    for grid in grids:
        html = F.regexp_replace(html, rf'(?s)<span id="{grid}_ctl\d+_[^"]*"[^>]*>.*?</span>', "")
    return redact(html)
