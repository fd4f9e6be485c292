"""Score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postkit import constants as K
from postkit.functions.text import ColumnOrName, _c


def ring_band(score: ColumnOrName) -> Column:
    """High >= 75, medium >= 50, else low; a missing score reads as medium."""
    s = _c(score)
    return (F.when(s.isNull(), F.lit("medium"))
            .when(s >= K.SCORE_HIGH, F.lit("high"))
            .when(s >= K.SCORE_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")))


def accent_band(score: ColumnOrName) -> Column:
    """Same cuts on ``coalesce(score, 0)``, so a missing score reads as low."""
    s = F.coalesce(_c(score), F.lit(0))
    return (F.when(s >= K.SCORE_HIGH, F.lit("high"))
            .when(s >= K.SCORE_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")))


def rating_band(score: ColumnOrName) -> Column:
    """The scorer's five-level guide; null stays null."""
    s = _c(score)
    expr = F.when(s.isNull(), F.lit(None).cast("string"))
    for cut, name in K.RATING_CUTS:
        expr = expr.when(s >= cut, F.lit(name))
    return expr.otherwise(F.lit(K.RATING_FLOOR))
