"""Several values packed in one field: split them into one value per row with their position.

A batch of strings is scanned as bytes: quote parity, brace depth and delimiter masks are computed for all cells of the
batch at once, each cell's notation is chosen from counts per cell, and the cuts become the child offsets of an Arrow list
array. Exploding that array gives one row per value; its ordinal is the position.

Notations: JSON and Python lists; quoted values; ``;`` ``；`` ``|`` bullet, tab, line break, spaced slash, ``、`` ``，``, mixed
in one cell; commas; for names also `` and `` and `` & ``, ``Surname, Given``, ``Surname I, Surname I`` and ``I. Surname, I. Surname``.
"""

from __future__ import annotations

import ast
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _find(data: np.ndarray, what: bytes) -> np.ndarray:
    """Mask of the bytes at which `what` begins."""
    hit = np.zeros(len(data), bool)
    if len(data) >= len(what):
        part = np.ones(len(data) - len(what) + 1, bool)
        for i, b in enumerate(what):
            part &= data[i : len(data) - len(what) + 1 + i] == b
        hit[: len(part)] = part
    return hit


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _per_cell(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over [start, end)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _pieces(data, offsets, cell, cut):
    """Children between cut bytes: their strings and their cells. Cut bytes belong to no child."""
    n = len(offsets) - 1
    at = np.flatnonzero(cut)
    first = at[np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(cell[at]) > 0)]))] if len(at) else at
    parents = np.concatenate([np.arange(n), cell[first]])
    begins = np.concatenate([offsets[:-1], first])
    order = np.lexsort((begins, parents))
    parents, begins = parents[order], begins[order]
    kept = ~cut
    rank = np.concatenate([[0], np.cumsum(kept)])
    child = np.concatenate([rank[begins], [rank[-1]]])
    return _strings(data[kept], child), parents


def split_strings(values: pa.Array, names: bool) -> pa.ListArray:
    """List array of the single values of each cell. Null and blank cells give empty lists; see packed_values()."""
    text = pc.utf8_trim_whitespace(pc.fill_null(values.cast(pa.string()), ""))
    text = pa.concat_arrays([text.take(pa.array(np.arange(len(text))))])
    n = len(text)
    if n == 0:
        return pa.array([], pa.list_(pa.string()))
    offsets = np.frombuffer(text.buffers()[1], np.int32, n + 1).astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[: offsets[-1]] if text.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    offsets = offsets - 0
    starts, ends = offsets[:-1], offsets[1:]
    size = ends - starts
    cell = np.repeat(np.arange(n), size)
    filled = size > 0
    if not len(data):
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    first, last = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    first[filled], last[filled] = data[starts[filled]], data[ends[filled] - 1]
    is_list = (first == ord("[")) & (last == ord("]")) & (size >= 2)
    lead = np.zeros(n, np.uint8)
    inner = is_list & (size > 2)
    lead[inner] = data[starts[inner] + 1]

    # Quote parity. Lists may escape quotes with a backslash; elsewhere an odd number of quotes means that none is one.
    backslash = data == ord("\\")
    escaped = np.concatenate([[False], backslash[:-1]])
    mark = np.where(is_list & (lead == ord("'")), ord("'"), ord('"')).astype(np.uint8)
    quote = (data == mark[cell]) & ~(escaped & is_list[cell])
    odd = _per_cell(quote, starts, ends) % 2 == 1
    quote &= ~odd[cell]
    seen = np.cumsum(quote)
    before = np.concatenate([[0], seen])[starts]
    quoted = ((seen - before[cell]) % 2 == 1) | quote
    opens, closes = (data == ord("{")) & ~quoted, (data == ord("}")) & ~quoted
    depth = np.cumsum(opens.astype(np.int64) - closes)
    base = np.concatenate([[0], depth])[starts]
    level = depth - base[cell]
    sound = (np.concatenate([[0], depth])[ends] == base) & ~is_list
    free = ~quoted & ~((level > 0) & sound[cell])

    space = _SPACE[data]
    next_space = np.concatenate([space[1:], [True]])
    comma = (data == ord(",")) & free
    semi = (data == ord(";")) & free
    wide_semi = _find(data, "；".encode()) & free
    slash = _find(data, b" / ") & free
    wide = wide_semi | (_find(data, "•".encode()) & free)
    hard3 = wide | slash | (_find(data, "、".encode()) & free) | (_find(data, "，".encode()) & free)
    hard1 = free & ((data == ord("|")) | (data == 9) | (data == 10) | (data == 13))

    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    count = lambda mask: _per_cell(mask, starts, ends)
    n_comma, n_semi, n_hard, n_quote = count(comma), count(semi), count(hard1 | hard3), count(quote)
    tight = count(comma & ~next_space)
    plain = ~is_list
    if names:
        conj = np.zeros(len(data), bool)
        conj_len = np.zeros(len(data), np.int64)
        for word in (b" and ", b" & "):
            hit = _find(lower, word) & free
            conj |= hit
            conj_len[hit] = len(word)
        n_conj = count(conj)
        by_hard = plain & ((n_semi > 0) | (n_hard > 0))
        pieces, parents = _pieces(data, offsets, cell, comma)
        pieces = pc.utf8_trim_whitespace(pieces)
        starts_initial = np.asarray(pc.match_substring_regex(pieces, r"^(?:(?:and |& )?(?:\p{Lu}\.[ -]?)+)"))
        ends_initial = np.asarray(pc.match_substring_regex(pieces, r"\s\p{Lu}{1,3}$"))
        no_text = np.asarray(pc.equal(pc.utf8_length(pieces), 0))
        group = np.searchsorted(parents, np.arange(n))
        all_initial = np.minimum.reduceat((starts_initial | no_text).astype(np.int8), group) == 1
        all_vancouver = np.minimum.reduceat((ends_initial | no_text).astype(np.int8), group) == 1
        first_initial = starts_initial[group]
        pairs = (n_comma % 2 == 1) & (n_comma >= 3)
        by_comma = plain & ~by_hard & (n_comma > 0) & (all_initial | (all_vancouver & (n_conj == 0)) | (first_initial & (n_conj > 0)) | ((n_quote > 0) & (n_conj == 0)))
        by_pair = plain & ~by_hard & ~by_comma & (n_conj == 0) & pairs & (n_quote == 0)
        cut_comma = comma & by_comma[cell]
        if by_pair.any():
            ordinal = np.cumsum(comma) - np.concatenate([[0], np.cumsum(comma)])[starts][cell]
            cut_comma |= comma & by_pair[cell] & (ordinal % 2 == 0)
        conj &= plain[cell]
    else:
        conj = None
        pieces, parents = _pieces(data, offsets, cell, semi)
        commas_in = np.asarray(pc.count_substring(pieces, ","))
        group = np.searchsorted(parents, np.arange(n))
        most = np.maximum.reduceat(commas_in, group)
        only_soft = plain & (n_hard == 0)
        comma_list = only_soft & (n_comma > 0) & (
            ((n_semi > 0) & ((tight > 0) | ((most >= 2) & (n_quote == 0))))
            | ((n_semi == 0) & ((n_comma >= 2) | (tight > 0) | (n_quote > 0)))
        )
        cut_comma = comma & comma_list[cell]
        semi &= ~comma_list[cell]
    cut = cut_comma | ((semi | hard1) & plain[cell])
    cut |= comma & is_list[cell]
    three = hard3 & plain[cell]
    for k in range(3):
        cut[k:] |= three[: len(three) - k]
    if conj is not None:
        for k in range(5):
            part = conj & (conj_len > k)
            cut[k:] |= part[: len(part) - k]
    cut[starts[is_list]] = True
    cut[ends[is_list] - 1] = True

    child, parents = _pieces(data, offsets, cell, cut)
    child = pc.utf8_trim_whitespace(child)
    # Enclosing quotes and braces, then doubled or escaped quotes within.
    marks = pa.array(mark[parents] == ord("'"))
    in_list = pa.array(is_list[parents])
    dq = pc.and_(pc.match_substring_regex(child, r'^"[\s\S]*"$'), pc.greater_equal(pc.binary_length(child), 2))
    sq = pc.and_(pc.and_(pc.match_substring_regex(child, r"^'[\s\S]*'$"), pc.greater_equal(pc.binary_length(child), 2)), pc.and_(marks, in_list))
    br = pc.and_(pc.match_substring_regex(child, r"^\{[\s\S]*\}$"), pc.invert(in_list))
    curly = pc.match_substring_regex(child, r"^“[^“”]*”$")
    wrapped = pc.or_(pc.or_(dq, sq), pc.or_(br, curly))
    child = pc.if_else(wrapped, pc.utf8_slice_codeunits(child, 1, -1), child)
    child = pc.if_else(pc.and_(dq, pc.invert(in_list)), pc.replace_substring(child, '""', '"'), child)
    child = pc.if_else(pc.and_(in_list, pc.or_(dq, sq)), pc.replace_substring_regex(child, r"\\([\"'\\/])", r"\1"), child)
    child = pc.utf8_trim_whitespace(child)
    keep = np.asarray(pc.greater(pc.binary_length(child), 0))
    sizes = np.bincount(parents[keep], minlength=n)
    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), child.filter(pa.array(keep)))

    # Lists whose strings need a full parser: other escapes, or both kinds of quotes.
    other = np.asarray(pc.match_substring_regex(text, r"\\[^\"'\\/]")) | (_per_cell(data == ord("'"), starts, ends) > 0) & (_per_cell(data == ord('"'), starts, ends) > 0) & (mark == ord("'"))
    hard_lists = np.flatnonzero(is_list & (other | odd))
    if len(hard_lists):
        # Only these cells are parsed; their lists are put in place of the others' by index.
        fixed, which = [], []
        for i in hard_lists:
            try:
                parsed = _parsed(text[int(i)].as_py())
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                continue
            fixed.append([s for s in (str(x).strip() for x in parsed if x is not None) if s])
            which.append(i)
        place = np.arange(n)
        place[which] = n + np.arange(len(which))
        out = pa.concat_arrays([out, pa.array(fixed, pa.list_(pa.string()))]).take(pa.array(place))
    return out


def _parsed(cell: str) -> list:
    try:
        found = json.loads(cell)
    except ValueError:
        found = ast.literal_eval(cell)
    if not isinstance(found, list):
        raise ValueError("no list")
    return found


@F.arrow_udf(T.ArrayType(T.StringType()))
def _terms(values: pa.Array) -> pa.Array:
    return split_strings(values, names=False)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _names(values: pa.Array) -> pa.Array:
    return split_strings(values, names=True)


def packed_values(col: Column | str, names: bool = False) -> Column:
    """array<string> of the values packed in a string column.

    Values are trimmed, without enclosing quotes, list marks or braces; empty values are dropped. A null, blank or
    delimiters-only cell gives an empty array. An odd number of quotes in a cell that is no list means that quotes don't
    protect delimiters there. A single comma separates nothing in a list of terms (``moisture, clay plaster``), unless
    values are quoted or no space follows it.
    """
    return (_names if names else _terms)(col)


def split_fields(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """(key, field, pos, item_text): one row per value of each field; fields maps a column to whether it holds names.

    df has one row per key. Rows with a null key come out with a null key. An empty table gives an empty result.
    """
    packed = F.array(*[F.struct(F.lit(f).alias("field"), packed_values(F.col(f"`{f}`"), names).alias("items")) for f, names in fields.items()])
    cells = df.select(F.col(f"`{key}`").alias(key), F.explode(packed).alias("_cell"))
    return cells.select(key, F.col("_cell.field").alias("field"), F.posexplode("_cell.items").alias("pos", "item_text"))
