"""The corpus pipeline of ``pairlens.llm.pipeline``: toxicity, near-duplicates, benchmark passages, personal data, byte-level BPE."""

from pairlens.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
