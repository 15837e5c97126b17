"""Declared schemas of the clinical source tables (CSV scans need no inference)."""

from __future__ import annotations

SCHEMAS = {
    "person": (
        "person_id bigint, year_of_birth int, month_of_birth int, day_of_birth int, "
        "race_concept_id int, ethnicity_concept_id int, gender_concept_id int"
    ),
    "visit_occurrence": (
        "visit_occurrence_id bigint, person_id bigint, visit_concept_id int, "
        "visit_start_date date, visit_end_date date"
    ),
    "condition_occurrence": (
        "person_id bigint, condition_start_date date, condition_end_date date, "
        "condition_concept_id int, condition_source_value string, "
        "condition_source_concept_vocabulary_id string, condition_type_concept_id int, "
        "visit_occurrence_id bigint"
    ),
    "drug_exposure": (
        "person_id bigint, drug_exposure_start_date date, drug_concept_id int, "
        "visit_occurrence_id bigint"
    ),
    "measurement": (
        "person_id bigint, measurement_date date, measurement_concept_id int, "
        "visit_occurrence_id bigint"
    ),
    "procedure_occurrence": (
        "person_id bigint, procedure_date date, procedure_concept_id int, "
        "visit_occurrence_id bigint"
    ),
    "observation": (
        "person_id bigint, observation_date date, observation_concept_id int, "
        "visit_occurrence_id bigint, value_as_string string"
    ),
    "concept": "concept_id int, concept_name string",
}

# domain -> (table, date column, concept column)
DOMAIN_TABLES = {
    "condition": ("condition_occurrence", "condition_start_date", "condition_concept_id"),
    "drug": ("drug_exposure", "drug_exposure_start_date", "drug_concept_id"),
    "measurement": ("measurement", "measurement_date", "measurement_concept_id"),
    "procedure": ("procedure_occurrence", "procedure_date", "procedure_concept_id"),
    "observation": ("observation", "observation_date", "observation_concept_id"),
}

EVENT_COLUMNS = (
    "person_id",
    "date",
    "domain",
    "concept_id",
    "source_code",
    "vocab_id",
    "type_concept_id",
    "visit_occurrence_id",
)
