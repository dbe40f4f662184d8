"""Provider resolution for address tables, written as Spark DataFrame operators."""

from gridlocus.session import build_session

__all__ = ["build_session"]
