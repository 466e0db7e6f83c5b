"""Review-text analytics as DataFrame -> DataFrame operators on Spark."""

from opinionmill.session import build_session

__all__ = ["build_session"]
