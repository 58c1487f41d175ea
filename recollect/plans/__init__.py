"""Registered queries. Importing the package registers them."""

from recollect.plans import evaluation, graphs, lookup, retrieval, streams, texts  # noqa: F401
from recollect.plans.registry import ORACLES, QUERIES  # noqa: F401
