"""The operators bound to the given tables, with the SQL each is checked against."""

from gridlocus.workload import columns, flows, matching, reporting, resolving  # noqa: F401
from gridlocus.workload.registry import ORACLES, QUERIES, runnable  # noqa: F401
