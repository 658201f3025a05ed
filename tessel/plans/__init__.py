"""Importing this package registers the inventory's queries."""

from . import core, functions, more  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
