"""Queries over the given tables, one per operator, each with its SQL where SQL can say it."""

from catalog import (answering, conversations, evaluation, features, models, preparation, profiling,  # noqa: F401
                     retrieval, routes, storage, text)
from catalog.registry import ORACLES, QUERIES  # noqa: F401
