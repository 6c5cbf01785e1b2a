"""Registered queries: importing the package fills the catalog."""

from tallyspan.plans import catalog, lifecycle  # noqa: F401
