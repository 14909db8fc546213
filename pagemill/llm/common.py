"""What the text operators share: Arrow batches, line identity, size-checked broadcasts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of text in an Arrow batch: about 2 MB at 2 kB a row, so that very long texts don't add up to much.
BATCH_ROWS = 1000
#: A side is broadcast only if it is measured to be no larger than this.
BROADCAST_BYTES = 8 << 20

BLANK = r"(?U)^[\s\x00]*$"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow, with the session's Arrow batches lowered to BATCH_ROWS rows (read when the plan runs, hence left so)."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    if int(old) > BATCH_ROWS or int(old) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def non_blank(text: str = "text") -> F.Column:
    """True where text has a character that isn't white space."""
    return F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))


DIGITS = re.compile(r"[0-9]+")
TEN_LETTERS = regex.compile(r"(?:\p{L}\P{L}*+){10}")


def line_form(line: str) -> str:
    """The line's identity: case folded, runs of white space as one space, runs of digits 0-9 as one 0."""
    return " ".join(DIGITS.sub("0", line).casefold().split())


def is_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows, at row_bytes each, fit the broadcast limit; counts no further than needed."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its measured size allows it, else df as it is (a shuffled join, which AQE may split)."""
    return F.broadcast(df) if is_small(df, row_bytes) else df
