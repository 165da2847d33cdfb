"""From raw documents to token ids: the stages of ``anualia.llm.pipeline``, under the name that jobs ask for."""

from anualia.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
