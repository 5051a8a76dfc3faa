"""All queries of this subpackage (importing the operator modules registers them)."""

from tickloom.llm import collocations, embeddings, lines, mixing, neardup, packing, personal, pieces, search, secrets, sharding, toxicity, whitening  # noqa: F401
from tickloom.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
