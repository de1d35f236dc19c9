"""Registered queries and their SQL."""

from . import citations, evidence, intake, search, stores  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
