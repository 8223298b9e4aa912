"""From documents to packed token ids; the stages are in ``tidemark.llm.pipeline``."""

from __future__ import annotations

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
