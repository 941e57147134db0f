"""All registered queries and their SQL oracles."""

from __future__ import annotations

from tessera.plans import (q_core, q_explain, q_features, q_io, q_models, q_profile, q_rules, q_segments,
                           q_stream)

_MODULES = [q_core, q_profile, q_features, q_io, q_segments, q_rules, q_explain, q_models, q_stream]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.SQL)
    return out


#: Queries that wait for full fits; they come last.
FULL_FITS = ("ml1_", "ml2_", "ml3_softmax", "ml4_", "ml7_predict", "ml8_", "ml10_", "ml11_cross_validation_balanced",
             "io5_", "sh1_fitted", "sh11_fitted")
