"""Similar-pattern search over time-ordered bars, expressed as Spark jobs."""

from windowmatch.config import SearchColumns

__all__ = ["SearchColumns"]
