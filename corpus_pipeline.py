"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL``, written in ``quelora/llm/pipeline.py``."""

from __future__ import annotations

from quelora.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
