"""Bindings of the operators to the driver tables, each with its SQL oracle."""

from evidencia.plans.registry import ORACLES, QUERIES  # noqa: F401
from evidencia.plans import (  # noqa: F401  (importing registers the queries)
    retrieval, scalars, history, graph, analytics, text, streams, functions,
)
