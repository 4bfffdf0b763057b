"""Registered queries over the star-schema tables."""

from . import decisions, evaluation, frames, histories, promotion, studies  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
