"""Keyed loads, a named-query gateway and report operators for a personal data lake on Spark."""

from millpond.model import ChartSpec, Connector, QuerySpec, Resource
from millpond.session import build_session, shared_folder

__all__ = ["ChartSpec", "Connector", "QuerySpec", "Resource", "build_session", "shared_folder"]
