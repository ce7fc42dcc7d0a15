"""Cohort and measurement analysis on Spark DataFrames."""

from .session import get_session

__all__ = ["get_session"]
