"""Mail headers in encoded words, decoded with the standard library in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def _decode(values: pd.Series) -> pd.Series:
    from email.header import decode_header, make_header

    def one(v):
        try:
            return None if v is None else str(make_header(decode_header(v)))
        except (LookupError, ValueError):
            return v

    return values.map(one)


def decoded_header(header: Column) -> Column:
    """The header's text; headers without encoded words never leave the JVM."""
    decode = F.pandas_udf(_decode, "string")
    return F.when(F.contains(header, F.lit("=?")), decode(header)).otherwise(header)
