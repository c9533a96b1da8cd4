"""shapeloom: structure inference for large JSON collections, as Spark DataFrame jobs."""

from shapeloom.session import configure

__all__ = ["configure"]
