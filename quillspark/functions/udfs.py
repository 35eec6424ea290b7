"""All Python functions on rows outside readers and state: what Spark has no expression for. Arrow batches throughout."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(DoubleType())
def ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two short strings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def round_like_python(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of the binary value, for callers that need it instead of Spark's decimal rounding."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits)])


@F.pandas_udf(StringType())
def title_case(x: pd.Series) -> pd.Series:
    """Capitals after every non-letter, which initcap does only after white space."""
    return x.map(lambda t: None if t is None else t.title())


def decoded(data: bytes | None) -> str | None:
    """Bytes as UTF-8 (with or without mark), else Windows-1252, else Latin-1."""
    if data is None:
        return None
    for code in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            return bytes(data).decode(code)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    return content.map(decoded)
