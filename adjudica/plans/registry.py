"""Imports the modules that register queries on the claims catalog."""

from adjudica.catalog import CLAIMS  # noqa: F401
from adjudica.plans import claims_queries  # noqa: F401
from adjudica.plans import report_queries  # noqa: F401
from adjudica.plans import flow_queries  # noqa: F401
