"""SQL functions: ``seq_access``, ``seq_rank``, ``seq_select``, ``poly_hash`` and the table function ``bytes_of``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fingerprint import P61, poly_hash


#: Signature, result and body of the functions that SQL itself can say: they become part of the plan.
SEQUENCE = (
    ("seq_access(text STRING, pos BIGINT)", "STRING", "CASE WHEN pos >= 0 AND pos < char_length(text) THEN substring(text, CAST(pos AS INT) + 1, 1) END"),
    ("seq_rank(text STRING, sym STRING, pos BIGINT)", "BIGINT", "CASE WHEN sym <> '' AND pos >= 0 AND pos < char_length(text) THEN CAST((pos + 1 - char_length(replace(substring(text, 1, CAST(pos AS INT) + 1), sym, ''))) / char_length(sym) AS BIGINT) END"),
    ("seq_select(text STRING, sym STRING, j BIGINT)", "BIGINT", "CASE WHEN sym <> '' AND j >= 1 AND (char_length(text) - char_length(replace(text, sym, ''))) / char_length(sym) >= j THEN CAST(char_length(substring_index(text, sym, CAST(j AS INT))) AS BIGINT) END"),
)


def poly_hash_61(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else poly_hash(t.encode(), P61) for t in texts], dtype="Int64")


class BytesOf:
    """(pos, byte) of a text's UTF-8 bytes."""

    def eval(self, text: str) -> Iterator[tuple[int, int]]:
        if text is not None:
            yield from enumerate(text.encode())


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for signature, kind, body in SEQUENCE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.udf.register("poly_hash", F.pandas_udf(poly_hash_61, T.LongType()))
    spark.udtf.register("bytes_of", F.udtf(BytesOf, returnType="pos: bigint, byte: int"))
