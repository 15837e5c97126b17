"""Lazily built stages over one set of input tables."""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.constants import GMM4_LABELS, GMM7_LABELS
from ..functions.stability import settle
from ..operators import comorbidity, concordance, features, mixture, rollup, rules, runs, spine, tuning
from ..sources import lens
from . import fixed_models


class Lab:
    """Plans for each stage; nothing runs until a result is consumed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.clinical = lens.load(spark, sf_dir)
        self.label_columns: Sequence[str] | None = None

    def keeping(self, columns: Sequence[str]) -> Lab:
        """This lab with only some columns of the labelled rows behind their checkpoint, which
        nothing prunes: what is not read later is neither computed nor written."""
        other = copy(self)
        for name in ("stored_labels", "tuned_threshold", "relabels", "relabelled"):
            other.__dict__.pop(name, None)
        other.label_columns = columns
        return other

    @cached_property
    def days(self) -> DataFrame:
        return spine.visit_days(self.clinical.visits)

    @cached_property
    def visit_cci(self) -> DataFrame:
        return comorbidity.visit_scores(self.clinical.events, self.clinical.visits)

    @cached_property
    def daily(self) -> DataFrame:
        return spine.daily(self.clinical.events, self.days, self.visit_cci)

    @cached_property
    def stored_daily(self) -> DataFrame:
        """Daily rows behind a checkpoint; later stages of this lab read them."""
        self.daily = settle(self.daily)
        return self.daily

    @cached_property
    def listed_daily(self) -> DataFrame:
        """Daily rows with their run-length lists."""
        return spine.daily(self.clinical.events, self.days, self.visit_cci, lists=True)

    @cached_property
    def stored_listed_daily(self) -> DataFrame:
        stored = settle(self.listed_daily)
        self.daily = stored.drop(*runs.LISTS)
        return stored

    @cached_property
    def months(self) -> DataFrame:
        """Month roll-up in one pass with its days, for a single reader."""
        return rollup.rollup_period(self.listed_daily, "month")

    @cached_property
    def stored_months(self) -> DataFrame:
        """Month roll-up, from which years follow."""
        return settle(rollup.rollup_period(self.stored_listed_daily, "month"))

    @cached_property
    def people(self) -> DataFrame:
        return spine.demographics(self.clinical.person, self.clinical.concepts)

    @cached_property
    def features(self) -> DataFrame:
        return features.person_year_features(self.daily, self.days)

    @cached_property
    def rules(self) -> DataFrame:
        return rules.classify(self.features)

    @cached_property
    def labelled(self) -> DataFrame:
        """Features with rule, 4- and 7-component labels and the cohort."""
        scored = mixture.predict(self.rules, fixed_models.model_4(), "gmm_4", GMM4_LABELS)
        scored = mixture.predict(scored, fixed_models.model_7(), "gmm_7", GMM7_LABELS)
        cohort = F.when(F.col("person_id") % 3 == 0, "cohort_2a").otherwise("cohort_1")
        return scored.withColumn("cohort", cohort)

    @cached_property
    def tuned_threshold(self) -> float:
        """Threshold that the search finds on the labelled rows, an action on its grid points."""
        return tuning.search_threshold(self.stored_labels, "L1")["threshold"]

    @cached_property
    def relabels(self) -> dict[str, DataFrame]:
        return {
            m: concordance.relabel(
                concordance.composition(self.stored_labels, f"{m}_cluster", "archetype"), f"{m}_cluster"
            )
            for m in ("gmm_4", "gmm_7")
        }

    @cached_property
    def relabelled(self) -> DataFrame:
        """Labelled rows plus reference-based names and the rule run at the tuned threshold."""
        second, _ = rules.archetype(threshold=self.tuned_threshold)
        df = self.stored_labels.withColumn("archetype_adaptive", second)
        for method, names in self.relabels.items():
            df = concordance.apply_labels(df, names, method)
        return df

    @cached_property
    def stored_labels(self) -> DataFrame:
        """Labelled rows behind a checkpoint, for operators that make several passes."""
        return settle(self.labelled.select(*self.label_columns) if self.label_columns else self.labelled)

    @cached_property
    def stored_features(self) -> DataFrame:
        """Features behind a checkpoint, for operators that make several passes."""
        return settle(self.features)


METHOD_COLUMNS = {
    "rules_vanilla": "archetype",
    "rules_adaptive": "archetype_adaptive",
    "gmm_4": "gmm_4_relabeled",
    "gmm_7": "gmm_7_relabeled",
}

#: What the methods' labels follow from: the stored ones, and what the tuned rule run reads.
COMPARED_COLUMNS = ("archetype", "gmm_4_cluster", "gmm_7_cluster", "inpatient_visit_count", "visit_count",
                    "irregularity_l1", "irregularity_score")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns, so results do not depend on summation order."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
