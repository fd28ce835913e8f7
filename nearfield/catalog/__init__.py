"""Every registered query; importing the package fills the registry."""

from nearfield.catalog import tables, text, vectors  # noqa: F401
from nearfield.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
