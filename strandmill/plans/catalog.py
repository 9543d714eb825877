"""All registered queries, in inventory order of their modules."""

from strandmill.plans import evaluation, features, rows, running  # noqa: F401
from strandmill.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
