"""Functions that Spark has no expression for, as Arrow-batched UDFs. Use them on distinct values."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lexmine.functions.fuzzy import weighted_ratio as _weighted
from lexmine.functions.porter import stem as _stem


def _each(function, values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else function(v) for v in values], dtype=object)


@F.pandas_udf(StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    """Porter stem of lower-case words."""
    return _each(_stem, words)


@F.pandas_udf(DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Fuzzy likeness of two texts, 0 to 100."""
    return pd.Series([None if x is None or y is None else _weighted(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def nfkc_fold(texts: pd.Series) -> pd.Series:
    """NFKC form, case-folded."""
    return _each(lambda t: unicodedata.normalize("NFKC", t).casefold(), texts)


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """Text with every HTML entity as its character."""
    return _each(html.unescape, texts)
