"""The corpus pipeline; its stages are in watchframe/llm/pipeline.py."""

from watchframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
