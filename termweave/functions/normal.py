"""Normal form of terms: NFKC, lower case, whitespace, hyphens and underscores to one space."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters besides white space that separate words: - _ U+2010-2014 U+2212.
_GAPS = re.compile("[\\s\\-_‐-—−]+")


def normal_form(term: str | None) -> str | None:
    """Normal form of one term; None stays None."""
    if term is None:
        return None
    if not term.isascii():
        term = unicodedata.normalize("NFKC", term)
    return _GAPS.sub(" ", term.lower()).strip()


def _normal_strings(values: pa.Array) -> pa.Array:
    """Each distinct string of a batch is normalised once."""
    coded = values.dictionary_encode()
    forms = pa.array([normal_form(x) for x in coded.dictionary.to_pylist()], pa.string())
    return forms.take(coded.indices)


@F.arrow_udf(T.StringType())
def _normal(values: pa.Array) -> pa.Array:
    return _normal_strings(values)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _normal_items(lists: pa.Array) -> pa.Array:
    lists = lists.cast(pa.list_(pa.string()))
    flat = _normal_strings(pc.list_flatten(lists))
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(sizes.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, flat, mask=lists.is_null())


def normal(col: Column | str) -> Column:
    """Normal form of a string column."""
    return _normal(col)


def normal_items(col: Column | str) -> Column:
    """Normal forms of an array<string> column, position by position; null arrays and null entries stay null."""
    return _normal_items(col)
