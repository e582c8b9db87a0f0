"""A training corpus from raw documents, stage by stage; see tablewright/llm/pipeline.py."""

from tablewright.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
