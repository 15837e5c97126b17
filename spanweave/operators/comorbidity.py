"""Charlson comorbidity from problem-list diagnosis codes.

A visit's groups travel as one bit mask (bit g = group g), so a single integer
column replaces seventeen flag columns in every shuffle. Masks combine with
``bit_or``, which Spark pre-aggregates before shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CCI_NAMES, CCI_WEIGHTS, PROBLEM_LIST_TYPE
from ..functions.local import small_table

# Code prefixes per group and prefix length, dots removed; length 0: whole codes.
GROUP_CODES = {
    1: {
        3: "410 412 I21 I22",
        4: "I252",
    },
    2: {
        3: "428 I43 I50",
        4: "I099 I110 I130 I132 I255 I420 I425 I426 I427 I428 I429 P290",
        5: "39891 40201 40211 40291 40401 40403 40411 40413 40491 40493",
    },
    3: {
        0: "36234",
        3: "440 441 I70 I71",
        4: "0930 4373 4431 4432 4433 4434 4435 4436 4437 4438 4439 4471 5571 5579 V434",
    },
    4: {
        0: "36234",
        3: "430 431 432 433 434 435 436 437 438 G45 G46 I60 I61 I62 I63 I64 I65 I66 I67 I68 I69",
        4: "H340",
    },
    5: {
        3: "290 F00 F01 F02 F03 G30",
        4: "F051 G311 G312",
        5: "29010 29011",
    },
    6: {
        3: (
            "341 342 343 344 345 346 347 348 360 361 362 363 364 365 366 367 490 491 492 493 494 495 "
            "496 500 501 502 503 504 505 I27 I28 J40 J41 J42 J43 J44 J45 J46 J47 J60 J61 J62 J63 J64 "
            "J65 J66 J67"
        ),
        4: "4168 4169 5064 5081 5088 I270 I279 J684 J701 J703",
    },
    7: {
        3: "725 M05 M06 M32 M33 M34",
        4: "4465 7100 7101 7102 7103 7104 7140 7141 7142 7148 M315 M351 M353 M360",
    },
    8: {
        3: "531 532 533 534 K25 K26 K27 K28",
    },
    9: {
        3: "570 571 B18 K73 K74",
        4: (
            "0706 0709 5733 5734 5738 5739 K700 K701 K702 K703 K709 K713 K714 K715 K717 K760 K762 "
            "K763 K764 K768 K769 V427 Z944"
        ),
        5: "07022 07023 07032 07033 07044 07054",
    },
    10: {
        4: (
            "2500 2501 2502 2503 2508 2509 E100 E101 E106 E108 E109 E110 E111 E116 E118 E119 E120 "
            "E121 E126 E128 E129 E130 E131 E136 E138 E139 E140 E141 E146 E148 E149"
        ),
    },
    11: {
        4: (
            "2504 2505 2506 2507 E102 E103 E104 E105 E107 E112 E113 E114 E115 E117 E122 E123 E124 "
            "E125 E127 E132 E133 E134 E135 E137 E142 E143 E144 E145 E147"
        ),
    },
    12: {
        3: "342 343 G81 G82",
        4: (
            "3341 3440 3441 3442 3443 3444 3445 3446 3449 G041 G114 G801 G802 G830 G831 G832 G833 "
            "G834 G839"
        ),
    },
    13: {
        3: "582 585 586 N18 N19 V56",
        4: (
            "5830 5831 5832 5834 5836 5837 5880 I120 I131 N032 N033 N034 N035 N036 N037 N052 N053 "
            "N054 N055 N056 N057 N250 V420 V451 Z490 Z491 Z492 Z940 Z992"
        ),
        5: "40301 40311 40391 40402 40403 40412 40413 40492 40493",
    },
    14: {
        3: (
            "140 141 142 143 144 145 146 147 148 149 150 151 152 153 154 155 156 157 158 159 160 161 "
            "162 163 164 165 170 171 172 174 175 176 179 180 181 182 183 184 185 186 187 188 189 190 "
            "191 192 193 194 195 200 201 202 203 204 205 206 207 208 C00 C01 C02 C03 C04 C05 C06 C07 "
            "C08 C09 C10 C11 C12 C13 C14 C15 C16 C17 C18 C19 C20 C21 C22 C23 C24 C25 C26 C30 C31 C32 "
            "C33 C34 C37 C38 C39 C40 C41 C43 C45 C46 C47 C48 C49 C50 C51 C52 C53 C54 C55 C56 C57 C58 "
            "C60 C61 C62 C63 C64 C65 C66 C67 C68 C69 C70 C71 C72 C73 C74 C75 C76 C81 C82 C83 C84 C85 "
            "C88 C90 C91 C92 C93 C94 C95 C96 C97"
        ),
        4: "2386",
    },
    15: {
        4: (
            "4560 4561 4562 5722 5723 5724 5728 I850 I859 I864 I982 K704 K711 K721 K729 K765 K766 "
            "K767"
        ),
    },
    16: {
        3: "196 197 198 199 C77 C78 C79 C80",
    },
    17: {
        3: "042 043 044 B20 B21 B22 B24",
    },
}
# Codes that additionally count in a second group (fixed values).
SECOND_GROUP = {13: "40403 40413 40493", 4: "4573"}
# Dropped when coded in ICD10CM or with no vocabulary (fixed values).
V_CODE_PATTERNS = ("V434%", "V4276%", "V420%", "V451%", "V56%")
# The validation cohorts do not list lung cancer.
VALIDATION_EXCLUDES = {"C34"}


def code_rows(variant: str = "main") -> list[tuple[int, str, int]]:
    """(prefix length, prefix, group); length 0 stands for a whole-code match."""
    excluded = VALIDATION_EXCLUDES if variant == "validation" else set()
    return [
        (length, code, group)
        for group, by_length in GROUP_CODES.items()
        for length, codes in by_length.items()
        for code in codes.split()
        if code not in excluded
    ]


def clean_code(col: Column) -> Column:
    return F.upper(F.translate(col, ".", ""))


def is_v_code_to_drop(code: str, vocab: str) -> Column:
    """True or unknown for V-codes in ICD10CM or without vocabulary."""
    like = " OR ".join(f"{code} LIKE '{pattern}'" for pattern in V_CODE_PATTERNS)
    return F.expr(f"{vocab} = 'ICD10CM' AND ({like})")


def with_groups(df: DataFrame, code_col: str = "code", variant: str = "main") -> DataFrame:
    """Add ``cc_group`` (first matching group or 0) and ``cc_second`` (or null).

    One broadcast lookup per prefix length against a fixed table of some 600
    rows. Groups are tested in ascending order, so the first match is the
    smallest matching group.
    """
    rows = code_rows(variant)
    found = []
    for length in sorted({r[0] for r in rows}):
        best: dict[str, int] = {}
        for n, prefix, group in rows:
            if n == length:
                best[prefix] = min(group, best.get(prefix, group))
        key, hit = f"_key{length}", f"_hit{length}"
        table = small_table(df.sparkSession, list(best.items()), f"{key} string, {hit} int")
        probe = F.substring(code_col, 1, length) if length else F.col(code_col)
        df = df.join(F.broadcast(table), probe == F.col(key), "left").drop(key)
        found.append(hit)
    seconds = " ".join(
        "WHEN " + " OR ".join(f"startswith({code_col}, '{p}')" for p in text.split()) + f" THEN {group}"
        for group, text in SECOND_GROUP.items()
    )
    return df.withColumns(
        {
            "cc_group": F.expr(f"coalesce(least({', '.join(found)}), 0)"),
            "cc_second": F.expr(f"CASE {seconds} END"),
        }
    ).drop(*found)


def _flag_text(mask: str, group: int) -> str:
    return f"CAST(shiftright({mask}, {group}) & 1 AS INT)"


def flag(mask: str, group: int) -> Column:
    return F.expr(_flag_text(mask, group))


def flag_columns(mask: str = "cci_mask") -> dict[str, Column]:
    return {f"cci_{name}": flag(mask, g) for g, name in enumerate(CCI_NAMES, start=1)}


def mask_of_flags() -> Column:
    """The mask of a table that has the flag columns instead."""
    return F.expr(" | ".join(f"shiftleft(CAST(cci_{name} AS BIGINT), {g})" for g, name in enumerate(CCI_NAMES, start=1)))


def score(mask: str) -> Column:
    """Weighted sum of the groups present; no hierarchy between related groups."""
    terms = [f"{w} * {_flag_text(mask, g)}" for g, w in enumerate(CCI_WEIGHTS, start=1)]
    return F.expr(" + ".join(terms))


def visit_scores(events: DataFrame, visits: DataFrame, variant: str = "main") -> DataFrame:
    """Per visit: group mask and score from same-year problem-list conditions.

    Codes are classified and reduced to one mask per (visit, calendar year)
    *before* the join, and that aggregation's partitioning is reused by the
    join, so the condition side shuffles once and only small rows cross it.
    """
    year = F.year("date").alias("cal_year")
    coded = events.filter(
        (F.col("domain") == "condition")
        & (F.col("type_concept_id") == PROBLEM_LIST_TYPE)
        & F.col("visit_occurrence_id").isNotNull()
        & F.col("source_code").isNotNull()
    ).select("visit_occurrence_id", year, clean_code(F.col("source_code")).alias("code"), "vocab_id")
    kept = with_groups(coded.filter(~is_v_code_to_drop("code", "vocab_id")), "code", variant)
    bits = F.expr(
        "if(cc_group > 0, shiftleft(1L, cc_group), 0L) | "
        "if(cc_second IS NOT NULL, shiftleft(1L, cc_second), 0L)"
    )
    masks = (
        kept.withColumn("mask", bits)
        .filter("mask <> 0")
        .groupBy("visit_occurrence_id", "cal_year")
        .agg(F.bit_or("mask").alias("cci_mask"))
    )
    starts = visits.select(
        "visit_occurrence_id",
        F.year("visit_start_date").alias("cal_year"),
        "person_id",
        F.to_date("visit_start_date").alias("date"),
    )
    return masks.join(starts, ["visit_occurrence_id", "cal_year"]).select(
        "visit_occurrence_id",
        "person_id",
        "date",
        "cci_mask",
        score("cci_mask").cast("int").alias("cci_total"),
    )


def daily_scores(visit_cci: DataFrame) -> DataFrame:
    """Per person and date: highest visit score and union of group flags."""
    return visit_cci.groupBy("person_id", "date").agg(
        F.max("cci_total").alias("cci_total"), F.bit_or("cci_mask").alias("cci_mask")
    )
