"""The query catalogue: each operator applied to whole tables, with its SQL twin."""

from . import associations, evaluation, models, preparation, profiles, quality_queries, storage  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
