"""Shared building blocks of the SQL oracle: named CTEs with their dependencies.

Each block states the result directly (joins, lists, per-step CASE logic); it
deliberately does not follow the shape of the Spark jobs.
"""

from __future__ import annotations

from ..functions.constants import CCI_NAMES, CCI_WEIGHTS, DOMAINS
from ..operators.comorbidity import GROUP_CODES, SECOND_GROUP
from ..sources import lens
from . import fixed_models


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else repr(v) for v in values) + "]"


def group_case(code: str) -> str:
    """First-match CASE over regular expressions."""
    whens = []
    for group, text in GROUP_CODES.items():
        parts = [code + "$" * (length == 0) for length, codes in text.items() for code in codes.split()]
        whens.append(f"WHEN regexp_matches({code}, '^({'|'.join(parts)})') THEN {group}")
    return "CASE " + " ".join(whens) + " ELSE 0 END"


SECOND_CASE = " ".join(
    f"WHEN regexp_matches(code, '^({'|'.join(text.split())})') THEN {group}"
    for group, text in SECOND_GROUP.items()
)
_WEIGHT = " ".join(f"WHEN {g} THEN {w}" for g, w in enumerate(CCI_WEIGHTS, start=1))
_FLAGS = list(enumerate(CCI_NAMES, start=1))
_CONCEPTS = ", ".join(f"({k}, '{v}')" for k, v in lens.CONCEPT_NAMES.items())

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, needs: str, sql: str) -> None:
    BLOCKS[name] = (tuple(needs.split()), sql.strip())


block("person", "", f"""
SELECT c_custkey AS person_id,
       CAST(1930 + c_custkey % 60 AS INTEGER) AS year_of_birth,
       CASE WHEN c_custkey % 10 <> 0 THEN CAST(1 + c_custkey % 12 AS INTEGER) END AS month_of_birth,
       CASE WHEN c_custkey % 7 <> 0 THEN CAST(1 + c_custkey % 28 AS INTEGER) END AS day_of_birth,
       {_list(lens.GENDERS)}[1 + c_custkey % 3] AS gender_concept_id,
       {_list(lens.RACES)}[1 + c_nationkey % 6] AS race_concept_id,
       {_list(lens.ETHNICITIES)}[1 + c_custkey % 4] AS ethnicity_concept_id,
       CASE WHEN c_custkey % 3 = 0 THEN 'cohort_2a' ELSE 'cohort_1' END AS cohort
FROM customer""")

block("concept", "", f"SELECT * FROM (VALUES {_CONCEPTS}) AS c(concept_id, concept_name)")

block("visit0", "", """
SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
       CAST(o_orderdate AS DATE) AS visit_start_date,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 9201
            WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 262
            WHEN o_orderpriority = '2-HIGH' THEN 9203
            WHEN o_orderpriority = '5-LOW' THEN 581477
            ELSE 9202 END AS visit_concept_id
FROM orders""")

block("visit", "visit0", """
SELECT *, CASE WHEN visit_occurrence_id % 29 = 0 THEN NULL
               WHEN visit_occurrence_id % 31 = 0 THEN visit_start_date - 2
               WHEN visit_concept_id IN (9201, 262)
                    THEN visit_start_date + CAST(visit_occurrence_id % 8 AS INTEGER)
               ELSE visit_start_date END AS visit_end_date
FROM visit0""")

block("event0", "", f"""
SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) + (l_linenumber % 4) AS date,
       {_list(lens.DOMAIN_OF_LINE)}[1 + l_linenumber % 5] AS domain,
       CAST(l_partkey % 97 AS INTEGER) AS concept_id,
       CASE WHEN l_linenumber % 5 = 1
            THEN {_list(lens.SOURCE_CODES)}[1 + l_partkey % 25] END AS source_code,
       CASE WHEN l_linenumber % 5 = 1
            THEN CASE WHEN l_linestatus = 'F' THEN 32840 ELSE 32020 END END AS type_concept_id,
       CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS visit_occurrence_id,
       l_partkey, l_linenumber, l_returnflag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

block("event", "event0", f"""
SELECT *, CASE WHEN source_code IS NULL THEN NULL
               WHEN source_code LIKE 'V%' THEN {_list(lens.V_CODE_VOCABS)}[1 + l_partkey % 3]
               WHEN regexp_matches(source_code, '^[A-Z]') THEN 'ICD10CM'
               ELSE 'ICD9CM' END AS vocab_id
FROM event0""")

block("visit_day", "visit", """
SELECT person_id, visit_occurrence_id,
       CASE WHEN visit_concept_id IN (9201, 262) THEN 1 ELSE 0 END AS is_hospitalized,
       CAST(UNNEST(generate_series(visit_start_date,
            CASE WHEN visit_end_date IS NULL OR visit_end_date < visit_start_date
                 THEN visit_start_date ELSE visit_end_date END, INTERVAL 1 DAY)) AS DATE) AS date
FROM visit""")

block("cci_code", "event visit", """
SELECT DISTINCT v.visit_occurrence_id, v.person_id, v.visit_start_date AS date,
       upper(replace(e.source_code, '.', '')) AS code, e.vocab_id
FROM event e JOIN visit v ON e.visit_occurrence_id = v.visit_occurrence_id
WHERE e.domain = 'condition' AND e.type_concept_id = 32840
  AND year(e.date) = year(v.visit_start_date)""")

block("cci_group", "cci_code", f"""
SELECT DISTINCT visit_occurrence_id, person_id, date, cc_group FROM (
  SELECT *, {group_case('code')} AS cc_group FROM cci_code
  UNION ALL
  SELECT *, CASE {SECOND_CASE} ELSE 0 END AS cc_group FROM cci_code) AS g
WHERE cc_group > 0
  AND NOT (regexp_matches(code, '^(V434|V4276|V420|V451|V56)') AND vocab_id = 'ICD10CM')""")

block("cci_visit", "cci_group", f"""
SELECT visit_occurrence_id, person_id, date,
       CAST(sum(CASE cc_group {_WEIGHT} END) AS INTEGER) AS cci_total,
       {", ".join(f"CAST(max(CASE WHEN cc_group = {g} THEN 1 ELSE 0 END) AS INTEGER) AS cci_{n}" for g, n in _FLAGS)}
FROM cci_group GROUP BY 1, 2, 3""")

block("cci_daily", "cci_visit", f"""
SELECT person_id, date, max(cci_total) AS cci_total,
       {", ".join(f"max(cci_{n}) AS cci_{n}" for _, n in _FLAGS)}
FROM cci_visit GROUP BY 1, 2""")

block("visit_count", "visit_day", """
SELECT person_id, date, count(DISTINCT visit_occurrence_id) AS visit_count,
       list(DISTINCT visit_occurrence_id) AS visit_ids,
       max(is_hospitalized) AS hospitalized_flag
FROM visit_day GROUP BY 1, 2""")

for d in DOMAINS:
    block(f"{d}_day", "event", f"""
SELECT person_id, date, list(concept_id) AS ids FROM event
WHERE domain = '{d}' AND concept_id IS NOT NULL GROUP BY 1, 2""")

block("listed", "event visit_day", " UNION ALL ".join(
    [f"SELECT person_id, date, '{d}_concept_ids' AS list, CAST(concept_id AS BIGINT) AS key, CAST(NULL AS VARCHAR) AS text "
     f"FROM event WHERE domain = '{d}' AND concept_id IS NOT NULL" for d in DOMAINS]
    + [f"SELECT person_id, date, '{name}', NULL, {c} FROM event WHERE domain = 'condition' AND {c} IS NOT NULL"
       for name, c in (("condition_source_codes", "source_code"), ("condition_vocab_ids", "vocab_id"))]
    + ["SELECT DISTINCT person_id, date, 'visit_occurrence_ids', visit_occurrence_id, NULL FROM visit_day "
       "WHERE visit_occurrence_id IS NOT NULL"]))

block("spine", "event visit_day", """
SELECT person_id, date FROM visit_day UNION SELECT person_id, date FROM event""")

_counts = ",\n       ".join(
    f"CAST(coalesce(len({d}_day.ids), 0) AS BIGINT) AS {d}_count, "
    f"CAST(coalesce(len(list_distinct({d}_day.ids)), 0) AS BIGINT) AS {d}_unique_ct, "
    f"CAST(coalesce(len(list_filter({d}_day.ids, lambda x: x = 0)), 0) AS BIGINT) AS {d}_nomatch_ct"
    for d in DOMAINS
)
_joins = "\n".join(f"LEFT JOIN {d}_day USING (person_id, date)" for d in DOMAINS)


def _sum_of(suffix: str) -> str:
    return " + ".join(f"{d}_{suffix}" for d in DOMAINS)


block("daily", "spine visit_count cci_daily " + " ".join(f"{d}_day" for d in DOMAINS), f"""
SELECT *, {_sum_of('count')} AS total_data_points,
       {_sum_of('unique_ct')} AS total_unique_concepts,
       {_sum_of('nomatch_ct')} AS total_nomatch_concepts,
       CASE WHEN {_sum_of('count')} > 0 THEN 1 ELSE 0 END AS has_clinical_concepts
FROM (SELECT spine.person_id, spine.date, coalesce(visit_count, 0) AS visit_count, visit_ids,
       coalesce(hospitalized_flag, 0) AS hospitalized_flag,
       {_counts},
       coalesce(cci_total, 0) AS cci_total,
       {", ".join(f"coalesce(cci_{n}, 0) AS cci_{n}" for _, n in _FLAGS)}
FROM spine LEFT JOIN visit_count USING (person_id, date)
{_joins}
LEFT JOIN cci_daily USING (person_id, date)) AS d""")

block("people", "person concept", """
SELECT person_id,
       CASE WHEN month_of_birth IS NULL THEN make_date(year_of_birth, 7, 1)
            WHEN day_of_birth IS NULL THEN make_date(year_of_birth, month_of_birth, 1)
            ELSE make_date(year_of_birth, month_of_birth, day_of_birth) END AS birth_date,
       CASE lower(g.concept_name) WHEN 'female' THEN 'Female' WHEN 'male' THEN 'Male'
            ELSE 'Unknown' END AS gender,
       CASE WHEN lower(e.concept_name) LIKE '%not hispanic%' THEN 'Not Hispanic or Latino'
            WHEN lower(e.concept_name) LIKE '%hispanic%' THEN 'Hispanic or Latino'
            WHEN e.concept_name IS NULL THEN 'Unknown'
            ELSE 'Not Hispanic or Latino' END AS ethnicity,
       CASE WHEN lower(r.concept_name) LIKE '%asians%' THEN 'Asian'
            WHEN lower(r.concept_name) LIKE '%white%' THEN 'White'
            WHEN lower(r.concept_name) LIKE '%black%' THEN 'Black'
            WHEN lower(r.concept_name) LIKE '%american indian%' THEN 'American Indian'
            WHEN lower(r.concept_name) LIKE '%hawaiian%' THEN 'Hawaiian'
            ELSE 'Unknown' END AS race
FROM person p LEFT JOIN concept g ON p.gender_concept_id = g.concept_id
LEFT JOIN concept e ON p.ethnicity_concept_id = e.concept_id
LEFT JOIN concept r ON p.race_concept_id = r.concept_id""")

AGE = ("CAST(year({d}) - year({b}) - CASE WHEN strftime({d}, '%m%d') < strftime({b}, '%m%d') "
       "THEN 1 ELSE 0 END AS BIGINT)")

block("gap", "daily", """
SELECT person_id, year(date) AS year, date_diff('day',
       lag(date) OVER (PARTITION BY person_id, year(date) ORDER BY date), date) AS gap, date
FROM daily WHERE visit_count > 0""")

block("regularity", "gap", """
SELECT person_id, year, CAST(sum(abs(gap * n - s)) AS DOUBLE) / max(n * s) AS irregularity_l1,
       sqrt(CAST(sum((gap * n - s) * (gap * n - s)) AS DOUBLE) / max(n)) / max(s) AS irregularity_l2,
       CAST(max(s) AS DOUBLE) / max(n) AS central_diff
FROM (SELECT *, CAST(sum(gap) OVER (PARTITION BY person_id, year) AS BIGINT) AS s,
             count(gap) OVER (PARTITION BY person_id, year) AS n FROM gap WHERE gap IS NOT NULL) AS g
WHERE n >= 2 AND s > 0 GROUP BY 1, 2""")

block("volume", "daily", """
SELECT person_id, year(date) AS year, min(date) AS year_first_date, max(date) AS year_last_date,
       count(DISTINCT date) AS days_observed, CAST(sum(visit_count) AS BIGINT) AS visit_count,
       CAST(count(*) FILTER (WHERE hospitalized_flag = 1) AS BIGINT) AS hospitalized_days,
       CAST(coalesce(len(list_distinct(flatten(list(visit_ids) FILTER (WHERE hospitalized_flag = 1)))), 0) AS BIGINT)
         AS inpatient_visit_count,
       max(cci_total) AS year_cci, max(cci_myocardial_infarction) AS y_mi,
       max(cci_congestive_heart_failure) AS y_chf,
       max(greatest(cci_diabetes_uncomplicated, cci_diabetes_complicated)) AS y_diabetes,
       max(greatest(cci_cancer, cci_metastatic_cancer)) AS y_cancer, max(cci_renal) AS y_ckd,
       CAST(sum(condition_count) AS BIGINT) AS total_condition_count,
       CAST(sum(drug_count) AS BIGINT) AS total_drug_count,
       CAST(sum(procedure_count) AS BIGINT) AS total_procedure_count,
       CAST(sum(measurement_count) AS BIGINT) AS total_measurement_count
FROM daily GROUP BY 1, 2""")

_cum = ", ".join(
    f"max({src}) OVER (PARTITION BY person_id ORDER BY year) AS {out}"
    for src, out in (("year_cci", "max_cci"), ("y_mi", "has_mi"), ("y_chf", "has_chf"),
                     ("y_diabetes", "has_diabetes"), ("y_cancer", "has_cancer"), ("y_ckd", "has_ckd"))
)
block("feature", "volume regularity", f"""
SELECT v.person_id, v.year, year_first_date, year_last_date, days_observed, visit_count,
       inpatient_visit_count, hospitalized_days, irregularity_l1, irregularity_l2,
       CASE WHEN irregularity_l1 IS NOT NULL THEN 1 ELSE 0 END AS has_valid_regularity,
       {_cum.replace('person_id', 'v.person_id').replace('BY year', 'BY v.year')},
       total_condition_count, total_drug_count, total_procedure_count, total_measurement_count
FROM volume v LEFT JOIN regularity r ON v.person_id = r.person_id AND v.year = r.year""")


def rule_case(threshold: str, score: str = "irregularity_l1") -> str:
    return (
        "CASE WHEN inpatient_visit_count >= 2 THEN 'Multiple Complex Episodes' "
        "WHEN inpatient_visit_count = 1 THEN 'Sporadic Complex Episodes' "
        "WHEN visit_count <= 1 THEN 'Sparse Use' "
        f"WHEN visit_count >= 4 AND coalesce({score}, 1.0) < {threshold} THEN 'Regular Frequent' "
        "WHEN visit_count >= 4 THEN 'Irregular Frequent' "
        f"WHEN coalesce({score}, 1.0) < {threshold} THEN 'Regular Infrequent' "
        "ELSE 'Irregular Infrequent' END"
    )


_SCORED = ("Regular Frequent", "Regular Infrequent", "Irregular Frequent", "Irregular Infrequent")
_shares = ", ".join(f"count(*) FILTER (WHERE a = '{a}') * 100.0 / count(*) AS p{i}" for i, a in enumerate(_SCORED))
_slopes = " + ".join(
    f"abs((coalesce(lead(p{i}) OVER w, p{i}) - coalesce(lag(p{i}) OVER w, p{i}))"
    " / (coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t)))" for i in range(len(_SCORED))
)
block("score_range", "feature", """
SELECT CASE WHEN greatest(a, 0.0) < least(b, 1.0) THEN greatest(a, 0.0) ELSE 0.0 END AS low,
       CASE WHEN greatest(a, 0.0) < least(b, 1.0) THEN least(b, 1.0) ELSE 1.0 END AS high
FROM (SELECT quantile_disc(irregularity_l1, 0.01) AS a, quantile_disc(irregularity_l1, 0.99) AS b
      FROM feature WHERE inpatient_visit_count = 0 AND visit_count >= 2 AND irregularity_l1 IS NOT NULL) AS q""")
block("grid_point", "score_range", """
SELECT i, round(low + i * 0.05, 6) AS t FROM score_range, range(0, 21) AS r(i) WHERE low + i * 0.05 < high + 0.025""")
# On the grid a missing score is regular nowhere, also at points above 1.
block("grid_slope", "grid_point", f"""
SELECT i, t, avg(d) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS slope
FROM (SELECT i, t, {_slopes} AS d
      FROM (SELECT i, t, {_shares} FROM (SELECT i, t, {rule_case('t', 'coalesce(irregularity_l1, 2.0)')} AS a FROM feature, grid_point) AS c GROUP BY 1, 2) AS k
      WINDOW w AS (ORDER BY i)) AS s""")
block("plateau", "grid_slope", """
SELECT a, least(z + 1, (SELECT max(i) FROM grid_slope)) AS z
FROM (SELECT min(i) AS a, max(i) AS z
      FROM (SELECT i, i - row_number() OVER (ORDER BY i) AS run FROM grid_slope
            WHERE slope <= (SELECT min(slope) + greatest(0.05, quantile_cont(slope, 0.1)) FROM grid_slope)) AS c
      GROUP BY run) AS r ORDER BY least(z + 1, (SELECT max(i) FROM grid_slope)) - a DESC, a LIMIT 1""")
block("tuned", "plateau", """
SELECT g.t AS threshold, p.z - p.a + 1 AS width, (SELECT min(slope) FROM grid_slope) AS least,
       (SELECT min(t) FROM grid_point) AS grid_min, (SELECT max(t) FROM grid_point) AS grid_max
FROM (SELECT CASE WHEN z > a THEN a ELSE 0 END AS a, CASE WHEN z > a THEN z ELSE 0 END AS z FROM plateau) AS p
JOIN grid_point g ON g.i = p.a + (p.z - p.a + 1) // 2""")
TUNED = "(SELECT threshold FROM tuned)"

block("rule", "feature", f"SELECT *, {rule_case('0.5')} AS archetype FROM feature")

block("tracked", "rule", """
SELECT *, row_number() OVER (PARTITION BY person_id, segment_id ORDER BY year)
          AS years_in_current_archetype
FROM (SELECT *, CAST(sum(archetype_changed) OVER (PARTITION BY person_id ORDER BY year) AS BIGINT) AS segment_id
      FROM (SELECT *, CASE WHEN prior IS NOT NULL AND prior <> archetype THEN 1 ELSE 0 END
                      AS archetype_changed
            FROM (SELECT *, lag(archetype) OVER (PARTITION BY person_id ORDER BY year) AS prior
                  FROM rule) AS a) AS b) AS c""")


block("score4", "feature", fixed_models.scores_sql("feature", fixed_models.WEIGHTS_4, fixed_models.MEANS_4, "f"))
block("score7", "score4", fixed_models.scores_sql(
    "(SELECT * EXCLUDE (x0, x1, x2, x3, x4, x5) FROM score4) AS s4",
    fixed_models.WEIGHTS_7, fixed_models.MEANS_7, "g"))
block("labelled", "score7", f"""
SELECT *, {rule_case('0.5')} AS archetype, {fixed_models.argmax_sql(4, 'f')} AS gmm_4_cluster,
       {fixed_models.argmax_sql(7, 'g')} AS gmm_7_cluster,
       CASE WHEN person_id % 3 = 0 THEN 'cohort_2a' ELSE 'cohort_1' END AS cohort
FROM score7""")


def _relabel(cluster: str) -> str:
    return f"""
SELECT {cluster}, max(first) AS dominant_or_first, max(p1) AS purity,
       CASE WHEN max(p1) >= 50 THEN max(first)
            WHEN sum(pct) FILTER (WHERE r <= 2) >= 50
                 THEN max(first) || coalesce(' + ' || max(second), '')
            ELSE 'Mixed' END AS relabeled,
       CASE WHEN max(p1) >= 50 THEN max(first) END AS dominant
FROM (SELECT *, CASE WHEN r = 1 THEN archetype END AS first, CASE WHEN r = 2 THEN archetype END AS second,
             CASE WHEN r = 1 THEN pct END AS p1
      FROM (SELECT *, row_number() OVER (PARTITION BY {cluster} ORDER BY pct DESC, archetype) AS r
            FROM (SELECT {cluster}, archetype,
                         count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY {cluster}) AS pct
                  FROM labelled GROUP BY 1, 2) AS a) AS b) AS c GROUP BY 1"""


block("relabel4", "labelled", _relabel("gmm_4_cluster"))
block("relabel7", "labelled", _relabel("gmm_7_cluster"))
block("relabelled", "relabel4 relabel7 tuned", f"""
SELECT l.*, {rule_case(TUNED)} AS archetype_adaptive, r4.relabeled AS gmm_4_relabeled,
       r7.relabeled AS gmm_7_relabeled
FROM labelled l JOIN relabel4 r4 ON l.gmm_4_cluster = r4.gmm_4_cluster
JOIN relabel7 r7 ON l.gmm_7_cluster = r7.gmm_7_cluster""")
_METHODS = {"gmm_4": "gmm_4_relabeled", "gmm_7": "gmm_7_relabeled",
            "rules_adaptive": "archetype_adaptive", "rules_vanilla": "archetype"}
_NAMES = ["rules_vanilla", "rules_adaptive", "gmm_4", "gmm_7"]
block("pair", "relabelled", " UNION ALL ".join(
    f"SELECT '{m1}' AS method1, '{m2}' AS method2, {_METHODS[m1]} AS a, {_METHODS[m2]} AS b FROM relabelled"
    for i, m1 in enumerate(_NAMES) for m2 in _NAMES[i + 1:]))
block("cell", "pair", """
SELECT *, sum(n) OVER (PARTITION BY method1, method2, a) AS row_n,
       sum(n) OVER (PARTITION BY method1, method2, b) AS col_n,
       sum(n) OVER (PARTITION BY method1, method2) AS total
FROM (SELECT method1, method2, a, b, count(*) AS n FROM pair GROUP BY 1, 2, 3, 4) AS p""")
block("ari", "cell", """
SELECT c.method1, c.method2, c.agreement, c.n_rows,
       (c.both_n - r.x * k.x / (c.n_rows * (c.n_rows - 1) / 2.0))
         / ((r.x + k.x) / 2.0 - r.x * k.x / (c.n_rows * (c.n_rows - 1) / 2.0)) AS ari
FROM (SELECT method1, method2, sum(n * (n - 1) / 2.0) AS both_n, CAST(sum(n) AS BIGINT) AS n_rows,
             coalesce(sum(n) FILTER (WHERE a = b), 0) * 1.0 / sum(n) AS agreement FROM cell GROUP BY 1, 2) AS c
JOIN (SELECT method1, method2, sum(row_n * (row_n - 1) / 2.0) AS x
      FROM (SELECT DISTINCT method1, method2, a, row_n FROM cell) AS q GROUP BY 1, 2) AS r
  ON c.method1 = r.method1 AND c.method2 = r.method2
JOIN (SELECT method1, method2, sum(col_n * (col_n - 1) / 2.0) AS x
      FROM (SELECT DISTINCT method1, method2, b, col_n FROM cell) AS q GROUP BY 1, 2) AS k
  ON c.method1 = k.method1 AND c.method2 = k.method2""")


def compose(needs: str, final: str) -> str:
    """A full query: the needed blocks in dependency order, then ``final``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in BLOCKS[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        visit(name)
    ctes = ",\n".join(f"{n} AS (\n{BLOCKS[n][1]}\n)" for n in ordered)
    return f"WITH {ctes}\n{final.strip()}"
