"""Registered queries over the business tables."""

from . import analytics, dashboards, domain, feeds, notices, operations, reviews, scoped  # noqa: F401
from .registry import QUERIES  # noqa: F401
