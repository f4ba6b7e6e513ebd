"""Dictionary extraction from HTML pages, written as Spark DataFrame jobs."""

from .params import ConvertParams

__all__ = ["ConvertParams"]
