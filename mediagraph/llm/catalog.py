"""All registered queries of this subpackage."""

from mediagraph.llm import queries  # noqa: F401
from mediagraph.llm.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
