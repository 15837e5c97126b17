"""Fixed mixture parameters, so that labelled queries have an exact oracle.

Diagonal covariance; means, centre and scale are in the transformed space
(log1p of capped counts). Ids follow the published label tables.
"""

from __future__ import annotations

import numpy as np

from ..functions.constants import clustering_features
from ..operators.mixture import Mixture, Preprocessing

FEATURES = tuple(clustering_features("BOTH"))
CAPS = {"visit_count": 12.0, "inpatient_visit_count": 4.0, "hospitalized_days": 20.0}
CENTER = (1.0, 0.2, 0.5, 0.15, 0.1, 0.12)
SCALE = (0.6, 0.4, 0.8, 0.4, 0.3, 0.35)
VARIANCE = (0.5, 0.6, 0.7, 0.4, 0.8, 0.9)

WEIGHTS_4 = (0.22, 0.36, 0.3, 0.12)
MEANS_4 = (
    (0.6, 1.2, 0.6, 0.2, 0.4, 0.4),
    (-0.7, -0.5, -0.6, -0.3, -0.3, -0.3),
    (0.5, -0.5, -0.6, 0.9, 0.4, 0.3),
    (1.4, 2.0, 2.2, 0.6, 0.8, 0.8),
)
WEIGHTS_7 = (0.14, 0.3, 0.16, 0.1, 0.14, 0.06, 0.1)
MEANS_7 = (
    (0.9, -0.5, -0.6, 1.2, 1.2, 1.2),
    (-0.8, -0.5, -0.6, -0.4, -0.3, -0.3),
    (0.2, 1.2, 0.2, -0.2, 0.0, 0.0),
    (1.2, 1.3, 2.4, 0.0, 0.3, 0.3),
    (0.3, -0.5, -0.6, 0.6, 0.0, 0.0),
    (1.8, 2.2, 2.0, 1.6, 1.2, 1.2),
    (1.0, 2.2, 1.0, 0.5, 0.4, 0.4),
)


def _model(weights, means) -> Mixture:
    prep = Preprocessing(FEATURES, CAPS, CENTER, SCALE)
    return Mixture(prep, np.array(weights), np.array(means), np.diag(VARIANCE))


def model_4() -> Mixture:
    return _model(WEIGHTS_4, MEANS_4)


def model_7() -> Mixture:
    return _model(WEIGHTS_7, MEANS_7)


def _scaled_sql(i: int) -> str:
    f = FEATURES[i]
    x = f"coalesce({f}, 0)"
    if f in CAPS:
        x = f"ln(1 + least({x}, {CAPS[f]}))"
    return f"({x} - {CENTER[i]}) / {SCALE[i]}"


def scores_sql(source: str, weights, means, alias: str) -> str:
    """SELECT with one log-score per component by squared distances."""
    xs = ", ".join(f"{_scaled_sql(i)} AS x{i}" for i in range(len(FEATURES)))
    scores = ", ".join(
        f"ln({w}) - 0.5 * (" + " + ".join(
            f"(x{i} - ({m})) * (x{i} - ({m})) / {VARIANCE[i]}" for i, m in enumerate(mean)
        ) + f") AS {alias}{c}"
        for c, (w, mean) in enumerate(zip(weights, means))
    )
    return f"SELECT *, {scores} FROM (SELECT *, {xs} FROM {source}) AS scaled"


def argmax_sql(k: int, alias: str) -> str:
    top = f"greatest({', '.join(f'{alias}{c}' for c in range(k))})"
    whens = " ".join(f"WHEN {alias}{c} = {top} THEN {c}" for c in range(k))
    return f"CASE {whens} END"
