"""All queries with their SQL."""

from gazeloom.plans import vision  # noqa: F401 - registers its queries
from gazeloom.plans.queries import QUERIES, SQL  # noqa: F401
