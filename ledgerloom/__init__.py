"""Retail data onboarding, integrity and quality checks as Spark jobs.

Data moves through three layers: raw text (every column a string), typed
tables, and rule views over the typed tables. Problems in the data are
reported, never silently repaired.
"""

from ledgerloom.model.schema import TABLES, Table
from ledgerloom.model.tables import RetailTables
from ledgerloom.session import build_session

__all__ = ["TABLES", "RetailTables", "Table", "build_session"]
