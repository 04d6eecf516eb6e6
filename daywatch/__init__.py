"""Behaviour analytics over activity logs, written as Spark DataFrame operators."""

from daywatch.session import get_session

__all__ = ["get_session"]
