"""Names: similarity, slugs, file names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tablecheck.session import ship_by_value

ship_by_value(__name__)


def similarity(a: str, b: str, floor: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio of lower-cased names; 0.0 when it cannot exceed ``floor``."""
    m = SequenceMatcher(None, a.lower(), b.lower())
    if floor > 0 and (m.real_quick_ratio() <= floor or m.quick_ratio() <= floor):
        return 0.0
    return m.ratio()


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two name columns; give it distinct pairs."""
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def column_pair_score(name: Column, overlap: Column) -> Column:
    return name * 0.6 + overlap * 0.4


def table_pair_score(name: Column, jaccard: Column) -> Column:
    return name * 0.3 + jaccard * 0.7


def match_type(name: Column) -> Column:
    return F.when(name > 0.5, "fuzzy_name").otherwise("value_overlap")


def slugify(text: Column) -> Column:
    """Lower case, every run of other characters becomes one dash."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
