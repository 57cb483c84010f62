"""Sources on small payload files of the published shapes, and sinks round trip."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.schemas import TABLES
from tessera.sources import common, html, knowledge, literature, registries, sinks


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(p)


def test_clinical_trials(spark, tmp_path):
    study = {"protocolSection": {"identificationModule": {"nctId": " NCT01 ", "briefTitle": "T"}, "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2020-01"}}, "designModule": {"phases": ["PHASE2"], "enrollmentInfo": {"count": 12}}, "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "x", "otherNames": ["y"]}]}, "contactsLocationsModule": {"locations": [{"country": "France"}, {"country": "France"}, {"country": " "}]}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "S"}}}, "hasResults": True}
    rows = registries.clinical_trials(spark, put(tmp_path, "a.json", {"studies": [study, {"protocolSection": {}}]})).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.source_id, r.countries, r.enrollment_count, r.has_results, r.sponsors, r.interventions[0].other_names, r.keywords) == ("NCT01", ["France"], 12, True, ["S"], ["y"], [])


def test_european_trials(spark, tmp_path):
    d = {"data": [{"ctNumber": "2023-1", "ctStatus": 2, "ctTitle": "Long", "shortTitle": " ", "trialCountries": ["Spain:2", "France:1", "Spain:9"], "trialPhase": "Therapeutic exploratory (Phase II)", "decisionDateOverall": "15/03/2023", "totalNumberEnrolled": "40"}]}
    r = registries.european_trials(spark, put(tmp_path, "e.json", d), {2: "AUTHORISED"}).first()
    assert (r.brief_title, r.status, r.countries, r.phases, r.first_posted_date, r.enrollment_count, r.has_results) == ("Long", "AUTHORISED", ["France", "Spain"], ["PHASE2"], "2023-03-15", 40, False)


WHO = "<ICTRP_export><trial><Trial><TrialID>{}</TrialID><Public_title>P</Public_title><Recruitment_status2>Not Recruiting</Recruitment_status2><Phase>2/3</Phase><Condition>Condition 1: a; nil</Condition><last_updated>10 January 2024</last_updated><Date_enrollement>01/06/2023</Date_enrollement></Trial></trial></ICTRP_export>"


def test_who_sources_agree(spark, tmp_path):
    xml = registries.who_xml(spark, put(tmp_path, "w.xml", "<?xml version='1.0'?>" + WHO.format("A1") + "\n<?xml version='1.0'?>" + WHO.format("A2")))
    assert sorted(r.source_id for r in xml.collect()) == ["A1", "A2"]
    r = xml.orderBy("source_id").first()
    assert (r.status, r.phases, r.conditions, r.last_update_date, r.start_date) == ("NOT_RECRUITING", ["PHASE2", "PHASE3"], ["a"], "2024-01-10", "2023-06-01")
    c = registries.who_csv(spark, put(tmp_path, "w.csv", 'TrialID,Public_title,Phase,Condition\nA1,"P, with comma",4,a;b\n')).first()
    assert (c.source_id, c.phases, c.conditions) == ("A1", ["PHASE4"], ["a", "b"])
    page = '<span id="DataList3_ctl01_TrialIDLabel">C/1</span><span id="DataList9_ctl02_ConditionLabel">b</span><span id="DataList9_ctl01_ConditionLabel">a<br>x</span><span id="DataList3_ctl01_Public_titleLabel">mail me@x.org</span>'
    p = registries.who_pages(spark.createDataFrame([(page,)], "html string"), "html").first()
    assert (p.source_id, p.conditions, p.brief_title) == ("C/1", ["a x", "b"], "mail [email removed]")


def test_british_trials_read_no_contacts(spark, tmp_path):
    xml = "<allTrials><fullTrial><trial><isrctn>123</isrctn><trialDescription><title>T</title></trialDescription><plainEnglishSummary>Write to a@b.org</plainEnglishSummary><contact><email>secret@b.org</email></contact><recruitmentCountries><country>UK</country></recruitmentCountries></trial></fullTrial></allTrials>"
    r = registries.british_trials(spark, put(tmp_path, "i.xml", xml)).first()
    assert r.source_id == "ISRCTN123" and r.countries == ["UK"] and "@" not in str(r)


PUBMED = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2019 Jan</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>A <i>b</i> c</ArticleTitle><Abstract><AbstractText Label='X'>One <b>two</b>.</AbstractText><AbstractText>Three.</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><AffiliationInfo><Affiliation>Paris</Affiliation></AffiliationInfo></Author></AuthorList><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"


def test_pubmed(spark, tmp_path):
    r = literature.pubmed(spark, put(tmp_path, "p.xml", PUBMED)).first()
    assert (r.source_id, r.title, r.abstract, r.year, r.publication_types, r.authors[0].affiliations) == ("7", "A b c", "One two.\nThree.", 2019, ["Review"], ["Paris"])


def test_full_text_sections(spark, tmp_path):
    xml = "<article><front><article-id pub-id-type='pmc'>PMC9</article-id><article-title>T</article-title></front><body><sec><title>Materials and methods</title><p>We <i>did</i>.</p></sec></body></article>"
    r = literature.full_text(spark, put(tmp_path, "j.xml", xml), {"materials and methods": "Methods"}).first()
    assert r.source_id == "9" and json.loads(r.raw_metadata)["full_text"] == "## Methods\n\nWe did."


def test_crossref_series_and_annotations(spark, tmp_path):
    w = {"message": {"items": [{"DOI": "10.1/A", "title": ["T"], "abstract": "<p>x</p>", "container-title": ["J"], "issued": {"date-parts": [[2020, 1]]}}, {"DOI": "10.1/b", "title": []}]}}
    r = literature.crossref(spark, put(tmp_path, "c.json", w)).collect()
    assert [(x.doi, x.year, x.abstract) for x in r] == [("10.1/a", 2020, "x")]
    s = literature.expression_series(spark, put(tmp_path, "g.json", [{"accession": "GSE1", "entrytype": "GSE", "pdat": "2020/01/02"}, {"accession": "GPL1", "entrytype": "GPL"}])).collect()
    assert [(x.source_id, x.year) for x in s] == [("GSE1", 2020)]
    doc = {"PubTator3": [{"pmid": "1", "passages": [{"infons": {"type": "title"}, "offset": 10, "text": "JAK1 is here", "annotations": [{"infons": {"type": "Gene", "identifier": "3716"}, "text": "JAK1", "locations": [{"offset": 10, "length": 4}]}]}], "relations": [{"infons": {"type": "Association", "score": "0.9", "role1": {"identifier": "3716"}, "role2": {"identifier": "D1"}}}, {"infons": {"type": "x", "role1": {"identifier": "1"}}}]}]}
    m, rel = literature.annotations(spark, put(tmp_path, "b.json", doc))
    assert (m.first().after, m.first().offset) == (" is here", 10) and [(x.score, x.second) for x in rel.collect()] == [(0.9, "D1")]


def test_gold_and_headings(spark, tmp_path):
    t, m, r = literature.gold_lines(spark, put(tmp_path, "g.txt", "1|t|A title\n1|a|Body\n1\t0\t5\tA tit\tDisease\tD1\n1\tCID\tD1\tD2\n"))
    assert (t.count(), m.first().concept, r.first().second) == (2, "D1", "D2")
    xml = "<DescriptorRecordSet><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>N</String></DescriptorName></DescriptorRecord><DescriptorRecord><DescriptorUI>D2</DescriptorUI></DescriptorRecord></DescriptorRecordSet>"
    assert [x.id for x in literature.headings(spark, put(tmp_path, "m.xml", xml), spark.createDataFrame([("D1",)], "id string")).collect()] == ["D1"]


def test_knowledge(spark, tmp_path):
    d = {"data": {"disease": {"id": "E1", "drugAndClinicalCandidates": {"rows": [{"maxClinicalStage": "PHASE_3", "drug": {"id": "C1", "name": "X"}}]}, "associatedTargets": {"rows": [{"score": 0.5, "target": {"id": "G1", "approvedSymbol": "JAK1"}}]}}}}
    m = {"data": {"drug": {"id": "C1", "mechanismsOfAction": {"rows": [{"mechanismOfAction": "inhibits", "actionType": "INHIBITOR", "targets": [{"id": "G1", "approvedSymbol": "JAK1"}]}]}}}}
    p, q = put(tmp_path, "d.json", d), put(tmp_path, "mm.json", m)
    assert knowledge.drug_priors(spark, p, q).first().mechanisms[0].targets[0].symbol == "JAK1" and knowledge.target_priors(spark, p).first().score == 0.5
    xml = "<drugbank xmlns='http://x'><drug type='a'><drugbank-id primary='true'>D1</drugbank-id><name>Alpha</name><groups><group>approved</group></groups><targets><target><name>T</name></target></targets></drug><drug><drugbank-id>D2</drugbank-id><name>Beta</name><description>for topic</description><targets><target><name>T</name></target></targets></drug><drug><drugbank-id>D3</drugbank-id><name>No</name></drug></drugbank>"
    drugs, targets = knowledge.drug_records(spark, put(tmp_path, "db.xml", xml), "Topic", spark.createDataFrame([("ALPHA ",)], "name string"))
    assert sorted(r.source_id for r in drugs.collect()) == ["D1", "D2"] and [(r.target, r.first_drug) for r in targets.collect()] == [("T", "D1")]
    tsv = "STUDY ACCESSION\tSNPS\tDISEASE/TRAIT\tMAPPED_TRAIT\tMAPPED_GENE\tP-VALUE\tOR or BETA\nS1\trs1\tTopic x\t\tA - B\t1e-9\t1.2\nS1\trs1\tTopic x\t\tA - B\t1e-9\t1.2\nS2\trs2\tOther\t\t\t\t\n"
    a = knowledge.associations(spark, put(tmp_path, "g.tsv", tsv), "topic").collect()
    assert [(r.source_id, r.p_value) for r in a] == [("S1:rs1", 1e-9)]
    with pytest.raises(ValueError, match="missing"):
        knowledge.associations(spark, put(tmp_path, "bad.tsv", "SNPS\nrs1\n"), "x")


def test_expression_files(spark, tmp_path):
    head = '!Sample_title\t"a"\t"b"\n!Sample_geo_accession\t"GSM1"\t"GSM2"\n!Sample_characteristics_ch1\t"tissue: skin"\t"tissue: blood"\n"ID_REF"\t"GSM1"\t"GSM2"\n"p1"\t1.5\t2.5\n"p2"\t\t3\n'
    f = put(tmp_path, "m.txt", head)
    s = {r["sample"]: r for r in knowledge.series_samples(spark, f).collect()}
    assert s["GSM2"].title == "b" and s["GSM1"].characteristics == {"tissue": "skin"}
    v = {(r.probe, r["sample"]): r.value for r in knowledge.expression_values(spark, f).collect()}
    assert v == {("p1", "GSM1"): 1.5, ("p1", "GSM2"): 2.5, ("p2", "GSM2"): 3.0}
    g = knowledge.probe_genes(spark, put(tmp_path, "a.tsv", "ID\tGene symbol\np1\tJAK1\np2\tA///B\n"))
    assert [(r.probe, r.gene) for r in g.collect()] == [("p1", "JAK1")]
    n = knowledge.sparse_counts(spark, put(tmp_path, "x.mtx", "%%MatrixMarket\n2 2 2\n1 1 5\n2 2 7\n"), put(tmp_path, "g2.tsv", "G1\tx\nG2\ty\n"), put(tmp_path, "c2.tsv", "C1\nC2\n"))
    assert {(r.gene, r.cell, r.n) for r in n.collect()} == {("G1", "C1", 5), ("G2", "C2", 7)}


def test_html(spark):
    page = "<style>x</style><p>A &amp; B</p><table><tr><th>n</th><th>m</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td>only</td></tr></table>"
    df = spark.createDataFrame([(page,), (None,)], "h string").select(html.page_text(F.col("h")).alias("t"), html.data_tables("h").alias("d"))
    a, b = df.collect()
    assert a.t.startswith("A & B") and a.d == [[["n", "m"], ["1", "2"]]] and b.t is None and b.d == []


def test_ranges_are_cut_until_they_fit():
    assert common.ranges(2000, 2003, lambda a, b: 6000 * (b - a + 1), 9999) == [(y, y) for y in range(2000, 2004)]


def test_payload_manifest(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    f = tmp_path / "raw" / "a.bin"
    f.write_bytes(b"one")
    m = common.payload_manifest(spark, str(tmp_path / "raw"))
    m = spark.createDataFrame(m.collect(), m.schema)
    assert common.damaged(m, common.payload_manifest(spark, str(tmp_path / "raw"))).count() == 0
    f.write_bytes(b"two")
    assert common.damaged(m, common.payload_manifest(spark, str(tmp_path / "raw"))).count() == 1


def test_upsert_is_idempotent_and_audited(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "store"))
    rows = common.conform(spark.createDataFrame([("a", "1", "T")], "source string, source_id string, title string"), "documents")
    assert store.upsert("documents", rows) == (1, 0) and store.upsert("documents", rows) == (0, 1)
    more = common.conform(spark.createDataFrame([("a", "1", "U"), ("a", "2", "V")], "source string, source_id string, title string"), "documents")
    assert sinks.changed_documents(store.read("documents"), more).count() == 1
    run = store.ingest("documents", more, "a", "q")
    assert (run["status"], run["inserted"], run["updated"]) == ("completed", 1, 1)
    assert {(r.source_id, r.title) for r in store.read("documents").collect()} == {("1", "U"), ("2", "V")}
    assert [(r.status, r.inserted) for r in store.runs().collect()] == [("completed", 1)]
    assert [r.status for r in spark.read.parquet(str(tmp_path / "store/ingestion_runs/log")).orderBy(F.col("completed_at").asc_nulls_first()).collect()] == ["running", "completed"]
    assert store.ingest_batches("documents", more, "a", "q", F.xxhash64("source_id"), 3) == {"inserted": 0, "updated": 2}


def test_exports(spark, tmp_path):
    edges = spark.createDataFrame([("a", "p", "b", 0.5, ["x", "y"])], "subject string, predicate string, object string, confidence double, evidence array<string>")
    sinks.flat_csv(edges, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().evidence == "x;y"
    sinks.licensed_release({"edges": edges}, F.exists("evidence", lambda e: e == "y"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/restricted/edges")).count() == 1
    assert "| a | p | b | 0.50 |" in sinks.markdown(edges.drop("evidence"))


def test_every_table_schema_parses(spark):
    for schema in TABLES.values():
        spark.createDataFrame([], schema)
