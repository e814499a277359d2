"""The twelve named operators by their id."""

from __future__ import annotations

from collections.abc import Callable

from gridlore.operators import change, intake, learning, report, rgb, sampling, similarity

OPERATORS: dict[str, Callable] = {
    "loadembedding": intake.load_embedding,
    "loadyears": intake.load_years,
    "torgb": rgb.render,
    "similarity": similarity.search,
    "change": change.change,
    "changeyears": intake.change_years,
    "changereport": report.change_report,
    "extract": sampling.extract,
    "classify": learning.fit_classifier,
    "classifyyears": learning.classify_years,
    "cluster": learning.cluster,
    "regress": learning.fit_regressor,
}


def run(operator: str, *args, **params):
    """Call an operator by its id."""
    if operator not in OPERATORS:
        raise KeyError(f"no operator {operator!r}; known: {', '.join(OPERATORS)}")
    return OPERATORS[operator](*args, **params)
