"""Item features, preference ranking, rating models and profiling on Spark DataFrames."""

from tallyrank.spec import ItemSpec, LineSpec, Stage, Terms

__all__ = ["ItemSpec", "LineSpec", "Stage", "Terms"]
