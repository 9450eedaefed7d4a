"""The one text function Spark lacks: decoding of HTML entities. Only values that hold an ampersand go to Python."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import clean, text


def _unescape(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())


def unescape(value: Column) -> Column:
    held = F.when(text(value).contains("&"), value)
    return F.coalesce(F.arrow_udf(_unescape, "string")(held), value)


def clean_decoded(value: Column) -> Column:
    """Entities decoded, then white space cleaned: for titles, names and identifiers, not for abstracts."""
    return clean(unescape(value))
