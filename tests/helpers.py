"""Tiny clinical inputs for edge cases."""

from datetime import date

EVENTS = ("person_id bigint, date date, domain string, concept_id int, source_code string, "
          "vocab_id string, type_concept_id int, visit_occurrence_id bigint")
VISITS = ("visit_occurrence_id bigint, person_id bigint, visit_concept_id int, "
          "visit_start_date date, visit_end_date date")


def d(text):
    return date.fromisoformat(text) if text else None


def visits(spark, rows):
    """(visit id, person, concept, start, end)"""
    return spark.createDataFrame([(v, p, c, d(a), d(b)) for v, p, c, a, b in rows], VISITS)


def conditions(spark, rows):
    """(person, date, code, vocabulary, visit id)"""
    data = [(p, d(t), "condition", 1, code, vocab, 32840, v) for p, t, code, vocab, v in rows]
    return spark.createDataFrame(data, EVENTS)


def no_events(spark):
    return spark.createDataFrame([], EVENTS)
