"""linkloom: web-link analytics as plain PySpark DataFrame operators."""

from linkloom.session import get_session

__all__ = ["get_session"]
