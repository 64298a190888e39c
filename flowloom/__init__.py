"""flowloom: network-flow analytics as Spark DataFrame operators."""

from flowloom.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
