"""Registered queries: each applies an operator to a view of the driver tables, with the SQL that checks it."""

from . import coding, conflict, documents, events, extract, lexicon, model, posterior, smoothed, sources  # noqa: F401

from . import coder  # noqa: F401, I001 (its views use those of extract)
from .views import QUERIES, SQL  # noqa: F401
