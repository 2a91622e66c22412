"""All queries of the subpackage."""

from boreline.llm import q_chat, q_fingerprints, q_leaks, q_mix, q_near, q_negatives, q_pages, q_quality, q_spelling, q_tokens  # noqa: F401
from boreline.llm.registry import QUERIES, SQL  # noqa: F401
