"""Synthetic features labelled by a private classifier, under one budget."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.generate import MergedNetwork, fit_private_tree
from tabloom.operators.ledger import Ledger
from tabloom.operators.private_models import NaiveBayes, naive_bayes
from tabloom.operators.split import shuffle_split
from tabloom.spec import TableSpec


@dataclass
class SelfLabelled:
    """`held_out` (n, accuracy) describes the classifier on real rows it has not seen; it carries no noise, so keep it inside."""

    features: MergedNetwork
    classifier: NaiveBayes
    target: str
    held_out: DataFrame
    spent: Ledger

    def sample(self, n: int, seed=0) -> DataFrame:
        return self.classifier.predict(self.features.sample(n, seed), self.target)


def fit_self_labelled(df: DataFrame, spec: TableSpec, bounds: Mapping[str, tuple[float, float]], epsilon: float, delta: float = 1e-9, *, classifier_share: float = 0.9,
                      test_share: float = 0.2, ledger: Ledger | None = None, seed=None) -> SelfLabelled:
    """A private naive Bayes model of the target takes `classifier_share` of epsilon and sees all rows but `test_share`;
    a private tree network of the features takes the rest and delta, over all rows.

    Both spend from one ledger of (epsilon, delta). `ledger` is the caller's: it is asked before any row is
    read and charged once both are fitted.
    """
    if not 0 < classifier_share < 1:
        raise ValueError("classifier_share must lie between 0 and 1")
    if not spec.numeric or spec.target is None:
        raise ValueError("a target and a numeric feature are needed")
    if ledger is not None:
        ledger.check(epsilon, delta)
    own = Ledger(epsilon, delta)
    parts = shuffle_split(df, spec.key, test_share, seed=0 if seed is None else seed)
    known = {c: bounds[c] for c in spec.numeric}
    classifier = naive_bayes(parts.where("part = 'train'"), known, spec.target, epsilon * classifier_share, ledger=own, seed=seed)
    features = fit_private_tree(df, spec.with_roles(target=None), epsilon - epsilon * classifier_share, delta, bounds=known, ledger=own, seed=seed)
    tested = classifier.predict(parts.where("part = 'test'"), "_predicted")
    held_out = tested.agg(F.count("*").alias("n"), F.avg((F.col("_predicted") == F.col(spec.target)).cast("double")).alias("accuracy"))
    if ledger is not None:
        ledger.spend(*own.total())
    return SelfLabelled(features, classifier, spec.target, held_out, own)
