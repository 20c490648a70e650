"""How alike two texts or numbers are."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of matching blocks over the total length; null with a null. For blocked pairs only."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[\s\-_/]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 where neither has one."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def model_score(query: Column, candidate: Column) -> Column:
    """10 for equal models, 6 and the share of length for a query within a candidate, 4 and the share
    the other way, 1 and three times the token overlap where there is one, else 0."""
    q, m = F.lower(F.trim(query)), F.lower(F.trim(candidate))
    near = jaccard(tokens(q), tokens(m))
    blank = (q == "") | (m == "") | q.isNull() | m.isNull()
    return (
        F.when(blank, 0.0).when(q == m, 10.0)
        .when(F.contains(m, q), 6.0 + F.length(q) / F.length(m))
        .when(F.contains(q, m), 4.0 + F.length(m) / F.length(q))
        .when(near > 0, 1.0 + 3.0 * near).otherwise(0.0)
    )


def tolerance_verdict(value: Column, truth: Column, correct: float = 0.02, partial: float = 0.05) -> Column:
    """'correct', 'partial' or 'wrong' by relative difference; a truth of 0 wants exactly 0."""
    off = F.try_divide(F.abs(value - truth), F.abs(truth))
    return (
        F.when(value.isNull() | truth.isNull(), F.lit("wrong"))
        .when(truth == 0, F.when(value == 0, "correct").otherwise("wrong"))
        .when(off <= correct, "correct").when(off <= partial, "partial").otherwise("wrong")
    )
