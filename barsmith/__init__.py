"""Daily-bar market analytics expressed as Spark DataFrame operators."""

from barsmith.session import configure, get_spark

__all__ = ["configure", "get_spark"]
