"""Exact nearest-neighbour outlier scoring for large point tables on Spark."""

from outskirt.job import score_points, score_table
from outskirt.params import ScoreParams

__all__ = ["ScoreParams", "score_points", "score_table"]
