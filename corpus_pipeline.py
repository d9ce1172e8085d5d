"""The training-data pipeline: stages applied in order to the documents table."""

from __future__ import annotations

from panelspark.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
