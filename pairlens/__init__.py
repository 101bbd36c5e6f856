"""Document-match analytics on PySpark."""

from pairlens.operators.match import MatchConfig
from pairlens.plans.analyze import analyze, every_pair

__all__ = ["MatchConfig", "analyze", "every_pair"]
