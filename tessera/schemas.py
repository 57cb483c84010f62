"""Declared schemas of the corpus tables; nothing is inferred.  Values of enumerations are lower case."""

from __future__ import annotations

# The enumerations of the data model.
ENTITY_KINDS = ("disease", "drug", "target", "trial", "mechanism", "pathway", "cell_type", "phenotype", "outcome", "variant", "study")
CLAIMS = ("asserted", "observed")

_PLACE = "country:string,city:string,facility:string"
_OUTCOME = "measure:string,description:string,time_frame:string"
_AUTHOR = "collective:string,last:string,fore:string,initials:string,affiliations:array<string>"
_MECHANISM = "mechanism:string,action_type:string,target_name:string,targets:array<struct<id:string,symbol:string,name:string>>"

TABLES: dict[str, str] = {
    "documents": f"source string, source_id string, title string, abstract string, journal string, year int, doi string, language string, authors array<struct<{_AUTHOR}>>, mesh_terms array<string>, keywords array<string>, publication_types array<string>, raw_metadata string",
    "embeddings": "document_id bigint, model string, scope string, dim int, vector array<float>",
    "document_chunks": "document_id bigint, model string, chunk_index int, section string, char_start int, char_end int, source_sha256 string, dim int, vector array<float>",
    "trials": "source string, source_id string, brief_title string, official_title string, summary string, status string, study_type string, phases array<string>, conditions array<string>, keywords array<string>, "
    f"interventions array<struct<type:string,name:string,description:string,other_names:array<string>>>, sponsors array<string>, locations array<struct<{_PLACE}>>, countries array<string>, primary_outcomes array<struct<{_OUTCOME}>>, "
    f"secondary_outcomes array<struct<{_OUTCOME}>>, enrollment_count int, sex string, minimum_age string, maximum_age string, healthy_volunteers boolean, start_date string, completion_date string, first_posted_date string, last_update_date string, has_results boolean, raw_metadata string",
    "priors": f"source string, kind string, source_id string, disease_id string, name string, description string, clinical_stage string, score double, synonyms array<string>, linked_trial_ids array<string>, linked_target_ids array<string>, mechanisms array<struct<{_MECHANISM}>>",
    "graph_entities": "kind string, key string, name string, aliases array<string>, external_ids map<string,string>",
    "graph_edges": "subject string, predicate string, object string, confidence double, extraction_method string, claim string, causal_level string, evidence array<string>",
    "genetic_associations": "source string, source_id string, trait string, mapped_trait string, variant string, mapped_gene string, reported_genes string, risk_allele string, p_value double, p_value_text string, odds_ratio_or_beta double, confidence_interval string, study_accession string, pubmed_id string",
    "research_projects": "source string, source_id string, title string, fiscal_year int, award_amount int, is_active boolean, contact_pi string, organization string, terms string, investigators array<string>",
    "ingestion_runs": "run_id string, source string, query string, status string, error string, started_at timestamp, completed_at timestamp, total_found bigint, fetched bigint, inserted bigint, updated bigint",
}

# Natural keys.
KEYS: dict[str, tuple[str, ...]] = {
    "documents": ("source", "source_id"),
    "embeddings": ("document_id", "model", "scope"),
    "document_chunks": ("document_id", "model", "chunk_index"),
    "trials": ("source", "source_id"),
    "priors": ("source", "kind", "source_id", "disease_id"),
    "graph_entities": ("kind", "key"),
    "graph_edges": ("subject", "predicate", "object"),
    "genetic_associations": ("source", "source_id"),
    "research_projects": ("source", "source_id"),
}
