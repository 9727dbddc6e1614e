"""textloom: prepare, budget, pack and measure text corpora with PySpark."""

from textloom.session import build_session
from textloom.workspace import freeze

__all__ = ["build_session", "freeze"]
