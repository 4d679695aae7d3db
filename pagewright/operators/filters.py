"""Thresholds of detection and recognition, each with its own strictness, as column predicates. Their defaults are the engine's."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.kernels import shapes

#: Least scores of a text and of an upside-down line.
TEXT_SCORE, TURN_SCORE = 0.5, 0.9


def finite(threshold: float) -> float:
    """The threshold, which must be a finite number."""
    if not math.isfinite(threshold):
        raise ValueError(f"a threshold of {threshold} isn't finite")
    return threshold


def bright(score: Column, threshold: float = shapes.BRIGHT) -> Column:
    """Above the threshold, in single precision."""
    return score.cast("float") > F.lit(finite(threshold)).cast("float")


def candidate(position: Column, most: int = shapes.CANDIDATES) -> Column:
    """Among the first of a page."""
    return position < most


def long_enough(side: Column, least: float) -> Column:
    """Not shorter than the least."""
    return ~(side < finite(least))


def scored(score: Column, least: float = shapes.BOX_SCORE) -> Column:
    """Not below the least."""
    return ~(score < finite(least))


def recognized(score: Column, least: float = TEXT_SCORE) -> Column:
    """The least score or more."""
    return score >= finite(least)


def upside_down(upright: Column, turned: Column, least: float = TURN_SCORE) -> Column:
    """The second class wins, not just ties, and is above the least."""
    return (turned > upright) & (turned > finite(least))
