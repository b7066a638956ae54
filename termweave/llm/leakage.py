"""Evaluation texts leaking into training text.

The word n-grams of the test items, normalised, form a hash set that every executor holds; document tokens are scanned
window by window for its members. Where several hits of one item lie on nearly one diagonal, the stretch is verified by
aligning its words with the item's, so that changed, dropped and inserted words are counted. Case, accents, punctuation,
spacing, line breaks, hyphenation, invisible characters, footnote marks and markup don't count.

Scan and verification work on numbers: a batch of documents is one array of word numbers, whose windows are looked up among
the n-grams at once; of the diagonals met, those whose words cannot agree often enough leave, and the rest are aligned
together, row by row.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.session import spread

#: Words in an n-gram; hits on one diagonal that call for verification; how far off a diagonal a hit may lie, also of items
#: shorter than the span.
GRAM, HITS, BAND, BAND_WHOLE = 3, 2, 8, 2
#: Words a passage must span at least, and items searched at a time.
SPAN, BLOCK = 15, 20_000
#: Share of the words of a passage that may be changed, dropped or inserted, and how many of them at its ends; the share
#: that a short item, which must be held whole, may lose.
CHANGED, ENDS, CHANGED_WHOLE = 0.25, 2, 0.2
#: Characters of documents that are scanned at once, and diagonals that are looked at together.
BATCH_CHARS, TOGETHER = 400_000, 2_000

_HIDDEN = "­​‌‍⁠⁡⁢⁣⁤﻿‎‏"
_PIECE = f"[^\\W_]+(?:[{_HIDDEN}̀-ͯ]+[^\\W_]*)*"
_TOKEN = re.compile(rf"<[^<>\n]{{1,80}}>|\[\d{{1,3}}\]|({_PIECE}(?:-[^\S\n]*\n\s*(?=[^\W\d_]){_PIECE})?)")
_DROP = re.compile(f"[{_HIDDEN}̀-ͯ\\s-]")
#: Letters of other scripts that look like Latin ones. Fixed values.
_ALIKE = str.maketrans("аеорсухіјѕԁһӏαορνικ", "aeopcyxijsdhlaopvik")
#: Word numbers: of marks that are no words, and of words that no item has.
_NO_WORD, _OTHER = -2, -1


def _folded(token: str) -> str:
    if token.isascii():
        return token.lower() if token.isalnum() else _DROP.sub("", token).lower()
    text = _DROP.sub("", "".join(c for c in unicodedata.normalize("NFKD", token.casefold()) if not unicodedata.combining(c)))
    if any("a" <= c <= "z" for c in text):
        text = text.translate(_ALIKE)
    return text


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words of a text and their places in it."""
    found = [(_folded(m[1]), m.span(1)) for m in _TOKEN.finditer(text) if m[1] is not None]
    return [w for w, _ in found if w], [p for w, p in found if w]


def _alike(a: str, b: str) -> bool:
    """Equal, or words of four letters or more with one slip."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if min(la, lb) < 4 or abs(la - lb) > 1 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


def _shortened(word: str) -> list[str]:
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))] if len(word) > 3 else [word]


class _Numbers(dict):
    """Number of each token as written: of an item's word, of one like an item's word, or _OTHER or _NO_WORD."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__({"": _NO_WORD})
        self.words = dict(vocabulary)
        self.near: dict[str, list[str]] = {}
        for w in vocabulary:
            for s in _shortened(w):
                self.near.setdefault(s, []).append(w)
        self.vocabulary = vocabulary
        self.alike: list[list[int]] = [self._like(w) for w in vocabulary]
        self.table: np.ndarray | None = None

    def _like(self, word: str) -> list[int]:
        met = {w for s in _shortened(word) for w in self.near.get(s, ()) if _alike(word, w)}
        return sorted(self.vocabulary[w] for w in met)

    def __missing__(self, token: str) -> int:
        word = _folded(token)
        n = self.words.get(word) if word else _NO_WORD
        if n is None:
            like = self._like(word)
            n = _OTHER
            if like:
                n = self.words[word] = len(self.alike)
                self.alike.append(like)
                self.table = None
        if len(self) > 500_000:
            self.clear()
            self[""] = _NO_WORD
        self[token] = n
        return n

    def likes(self) -> np.ndarray:
        """Per word number the items' words it is like, padded; the last row is that of _OTHER."""
        if self.table is None:
            wide = max(map(len, self.alike), default=1)
            self.table = np.full((len(self.alike) + 1, max(wide, 1)), -3, np.int32)
            for i, like in enumerate(self.alike):
                self.table[i, : len(like)] = like
        return self.table


class Items:
    """Test items, the hash set of their n-grams, and the search for their passages.

    Items of at least `span` words are found by stretches, by their 3-grams; shorter ones must be held whole and are found by
    their 2-grams, those of less than five words by themselves.
    """

    def __init__(self, rows: list[tuple[int, str]], span: int = SPAN):
        self.span = span
        texts = [(k, words(text or "")[0]) for k, text in rows]
        texts = [(k, w) for k, w in texts if w]
        self.keys = [k for k, _ in texts]
        vocabulary: dict[str, int] = {}
        coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in item] for _, item in texts]
        self.sizes = np.array([len(x) for x in coded], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.matrix = np.full((len(coded), self.longest), -9, np.int32)
        for i, x in enumerate(coded):
            self.matrix[i, : len(x)] = x
        self.numbers = _Numbers(vocabulary)
        self.base = len(vocabulary) + 1
        self.need = np.minimum(self.sizes, span)
        # A stretch of n words with c changes has n - c - 2 (c + 1) 3-grams at least, two where a quarter of 15 or more changes.
        self.by_gram = {2: self._grams(coded, 2, 5, span), GRAM: self._grams(coded, GRAM, span, 1 << 30)}
        self.whole: dict[int, tuple] = {n: self._grams(coded, n, n, n + 1) for n in range(1, 5)}

    def _grams(self, coded: list[list[int]], size: int, least: int, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct grams, their first entries, items, places) of the items of least to below words."""
        rows = [(self._key(x[i : i + size]), n, i) for n, x in enumerate(coded) if least <= len(x) < below for i in range(len(x) - size + 1)]
        rows.sort()
        keys = np.array([r[0] for r in rows], np.uint64)
        grams, first = np.unique(keys, return_index=True)
        return grams, np.append(first, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)

    def _key(self, numbers: list[int]) -> int:
        key = 0
        for x in numbers:
            key = (key * self.base + x + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def _met(self, codes: np.ndarray, size: int, grams: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in codes, item, place in item) of all windows that are grams."""
        distinct, first, items, places = grams
        if not len(distinct) or len(codes) < size:
            none = np.zeros(0, np.int64)
            return none, none, none
        known = (codes >= 0) & (codes < self.base - 1)
        every = known[: len(known) - size + 1].copy()
        for k in range(1, size):
            every &= known[k : len(known) - size + 1 + k]
        at = np.flatnonzero(every)
        with np.errstate(over="ignore"):
            key = np.zeros(len(at), np.uint64)
            for k in range(size):
                key = key * np.uint64(self.base) + (codes[at + k] + 1).astype(np.uint64)
        slot = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
        hit = distinct[slot] == key
        at, slot = at[hit], slot[hit]
        n = first[slot + 1] - first[slot]
        entry = np.repeat(first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(at, n), items[entry], places[entry]

    def search(self, texts: list[str], explain: bool = True) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text, item, agreeing, changed, first word, end word, item words) of all passages; words as words() counts them."""
        numbers, parts, starts, total = self.numbers, [], [], 0
        for text in texts:
            codes = np.fromiter(map(numbers.__getitem__, _TOKEN.findall(text)), np.int64)
            codes = codes[codes != _NO_WORD]
            starts.append(total)
            parts += [codes, np.full(1, _OTHER, np.int64)]
            total += len(codes) + 1
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        start = np.array([*starts, total], np.int64)
        out: list[tuple] = []
        for size, grams in self.whole.items():
            at, item, _ = self._met(codes, size, grams)
            text = np.searchsorted(start, at, "right") - 1
            out += [(t, i, size, 0, a, a + size, size) for t, i, a in zip(text.tolist(), item.tolist(), (at - start[text]).tolist())]
        for size, grams in self.by_gram.items():
            at, item, place = self._met(codes, size, grams)
            text = np.searchsorted(start, at, "right") - 1
            text, item, centre = self._diagonals(text, item, at - place, size)
            for k in range(0, len(item), TOGETHER):
                part = slice(k, k + TOGETHER)
                out += self._verified(codes, start, text[part], item[part], centre[part])
        return _explained(_disjoint(out)) if explain else _disjoint(out)

    def _diagonals(self, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, middle) of the groups of hits that lie within BAND diagonals, from the least one on, with enough hits."""
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        group = np.cumsum(new) - 1
        band = BAND if size == GRAM else BAND_WHOLE
        first, rest = np.flatnonzero(new), np.arange(len(text))
        heads, sizes = [], []
        least = diagonal[first] if len(first) else diagonal
        while len(rest):
            inside = diagonal[rest] <= least[group[rest]] + band
            taken = rest[inside]
            g, at, n = np.unique(group[taken], return_index=True, return_counts=True)
            heads.append(taken[at + n // 2])
            sizes.append(n)
            rest = rest[~inside]
            if len(rest):
                g, at = np.unique(group[rest], return_index=True)
                least[g] = diagonal[rest[at]]
        if not heads:
            return text, item, diagonal
        heads, sizes = np.concatenate(heads), np.concatenate(sizes)
        heads = heads[sizes >= (HITS if size == GRAM else 1)]
        return text[heads], item[heads], diagonal[heads]

    def _verified(self, codes, start, text, item, centre) -> list[tuple]:
        """The passages near diagonals, given by their texts, items and places of the items' first words in codes."""
        likes, n = self.numbers.likes(), self.longest
        width = 2 * BAND + 1
        places = centre[:, None] - BAND + np.arange(n + width - 1)
        inside = (places >= start[text][:, None]) & (places < start[text + 1][:, None] - 1)
        window = np.where(inside, codes[np.clip(places, 0, len(codes) - 1)], _OTHER)
        mine = self.matrix[item]
        agree = np.zeros((len(item), n, width), bool)
        for column in likes.T:  # most words are like themselves only
            like = column[window]  # _OTHER is the last row
            rows = np.flatnonzero((like >= 0).any(1))
            for k in range(width):
                agree[rows, :, k] |= like[rows, k : k + n] == mine[rows]
        # No passage where no stretch of the needed length has three of five words somewhere in the band.
        met = np.concatenate([np.zeros((len(item), 1), np.int64), np.cumsum(agree.any(2), 1)], 1)
        need = self.need[item]
        most = np.zeros(len(item), np.int64)
        for length in np.unique(need).tolist():
            rows = need == length
            most[rows] = (met[rows, length:] - met[rows, : n + 1 - length]).max(1)
        kept = np.flatnonzero(most >= np.ceil(0.6 * need))
        if not len(kept):
            return []
        agree = agree[kept]
        # Copies of a short item may lie closer together than the band is wide.
        off = np.where(self.sizes[item[kept]] < self.span, BAND_WHOLE, BAND)
        steps = self._align(agree, inside[kept], self.sizes[item[kept]], np.abs(np.arange(width) - BAND) <= off[:, None])
        out = []
        for x, row in enumerate(kept.tolist()):
            way, begin = steps[x], int(centre[row]) - int(start[text[row]])
            out += [(int(text[row]), int(item[row]), *found) for found in _stretches(way, agree[x], begin, int(need[row]), bool(self.sizes[item[row]] < self.span))]
        return out

    @staticmethod
    def _align(agree: np.ndarray, inside: np.ndarray, sizes: np.ndarray, band: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """Per diagonal (steps, last item word, last cell) of the best local alignment in its band.

        An alignment hardly counts changes, so that it goes on to the last agreeing word however many changes lie before it.
        Steps: 1 agreeing, 2 changed, 3 an item's word left out, 4 a word put in; 0 is where the alignment begins.
        """
        count, n, width = agree.shape
        score = np.zeros((count, width), np.int32)
        ways = np.zeros((count, n, width), np.int8)
        best, row_of, cell_of = np.zeros(count, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
        slope = 4 * np.arange(width, dtype=np.int32)
        for i in range(int(sizes.max())):
            along = score + np.where(agree[:, i], 6, -1)
            down = np.full_like(score, -99)
            down[:, :-1] = score[:, 1:] - 4
            step = np.where(down > along, 3, np.where(agree[:, i], 1, 2)).astype(np.int8)
            here = inside[:, i : i + width] & band
            now = np.where(here & (i < sizes)[:, None], np.maximum(along, down), -99)
            across = np.maximum.accumulate(now + slope, 1) - slope
            step[across > now] = 4
            now = np.where(here, across, 0)
            step[now <= 0] = 0
            score = np.maximum(now, 0)
            ways[:, i] = step
            cell = score.argmax(1)
            top = score[np.arange(count), cell]
            better = (top > best) & (i < sizes)
            best[better], row_of[better], cell_of[better] = top[better], i, cell[better]
        return [(ways[x], int(row_of[x]), int(cell_of[x])) for x in range(count)]


def _stretches(way: tuple[np.ndarray, int, int], agree: np.ndarray, begin: int, need: int, whole: bool) -> list[tuple[int, int, int, int, int]]:
    """(agreeing, changed, first word, end word, item words) of the passages on one alignment.

    Of the stretches that begin and end with agreeing words those with few enough changes count, the best first, then the
    best of what lies before and after it. Up to ENDS changed words at the ends may be missing to the need and count as
    changes; so a shorter quotation is none. A short item must be held whole.
    """
    steps, i, k = way
    steps, width = steps.tolist(), agree.shape[1]
    agreed: list[tuple[int, int, int]] = []  # item word, doc word, changes up to the end
    changes = 0
    while i >= 0 and 0 <= k < width and (step := steps[i][k]):
        if step == 1:
            agreed.append((i, begin + i - BAND + k, changes))
        else:
            changes += 1
        if step == 4:
            k -= 1
        else:
            i, k = i - 1, k + (step == 3)
    if not agreed:
        return []
    a, c, left = (np.array(x, np.int64) for x in zip(*agreed[::-1]))
    spanned = a[None, :] - a[:, None] + 1
    edits = left[:, None] - left[None, :]
    agreeing = np.arange(len(a))[None, :] - np.arange(len(a))[:, None] + 1
    missing = np.maximum(need - spanned, 0)
    share = CHANGED_WHOLE if whole else CHANGED
    fits = (spanned >= need - ENDS) & (agreeing > 0) & (edits + missing <= share * (spanned + missing))
    value = np.where(fits, 2 * agreeing - 3 * edits, -(1 << 30))
    out, todo = [], [(0, len(a))]
    while todo:
        low, high = todo.pop()
        if high - low < 1:
            continue
        part = value[low:high, low:high]
        p, q = divmod(int(part.argmax()), high - low)
        if part[p, q] == -(1 << 30):
            continue
        p, q = p + low, q + low
        out.append((int(agreeing[p, q]), int(edits[p, q] + missing[p, q]), int(c[p]), int(c[q]) + 1, int(spanned[p, q])))
        todo += [(low, p), (q + 1, high)]
    return out


def _disjoint(found: list[tuple]) -> list[tuple]:
    """Of overlapping passages of one item in one text the one that agrees best."""
    out: list[tuple] = []
    kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for row in sorted(set(found), key=lambda r: (r[0], r[1], 3 * r[3] - 2 * r[2], r[4])):
        taken = kept.setdefault((row[0], row[1]), [])
        if all(row[5] <= a or row[4] >= b for a, b in taken):
            taken.append((row[4], row[5]))
            out.append(row)
    return out


def _explained(found: list[tuple]) -> list[tuple]:
    """Without passages that only changes make, where another item explains the same words better.

    Items are often made after one pattern: where a text holds one, others agree with it in the words of the pattern. Such a
    passage is dropped if another item's passage covers four fifths of it, agrees in more words, and has a smaller share of
    changes. Passages without changes always stay.
    """
    by_text: dict[int, list[tuple]] = {}
    for row in found:
        by_text.setdefault(row[0], []).append(row)
    out = []
    for rows in by_text.values():
        for b in rows:
            better = b[3] > 0 and any(a[1] != b[1] and a[2] > b[2] and a[3] * (b[2] + b[3]) < b[3] * (a[2] + a[3]) and 5 * (min(a[5], b[5]) - max(a[4], b[4])) >= 4 * (b[5] - b[4]) for a in rows)
            if not better:
                out.append(b)
    return out


_held: dict[str, Items] = {}


def _items_of(name: str, rows: list[tuple[int, str]], span: int) -> Items:
    """The items of a broadcast, built once per worker."""
    if name not in _held:
        _held.clear()
        _held[name] = Items(rows, span)
    return _held[name]


def _leaks_in(held: Items, texts: list[str], explain: bool = True):
    """(text, item, agreeing, changed, first character, end character, share of the item, first word, end word)."""
    places: dict[int, list[tuple[int, int]]] = {}
    for t, i, agreeing, changed, a, b, spanned in held.search(texts, explain):
        if t not in places:
            places[t] = words(texts[t])[1]
        yield t, i, agreeing, changed, places[t][a][0], places[t][b - 1][1], spanned / int(held.sizes[i]), a, b


_COLUMNS = (("agreeing", pa.int32()), ("changed", pa.int32()), ("begins", pa.int32()), ("ends", pa.int32()), ("item_share", pa.float64()), ("_first", pa.int32()), ("_end", pa.int32()))


def _explained_rows(found: pa.Table) -> pa.Table:
    """The passages of one text, of all blocks of items, that no other item explains better."""
    columns = [found.column(c).to_pylist() for c in (1, "agreeing", "changed", "_first", "_end")]
    rows = [(0, item, agreeing, changed, first, end, n) for n, (item, agreeing, changed, first, end) in enumerate(zip(*columns))]
    return found.take(pa.array(sorted(r[6] for r in _explained(rows)), pa.int64()))


def find_passages(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(doc_key, item_key, agreeing, changed, begins, ends, item_share): one row per passage; an item may have several in a text.

    begins and ends are characters of the text. Null and empty texts leak nothing; an item shorter than the span must be held
    whole, one of less than five words unchanged. Documents are scanned whole, in place, unless there are fewer partitions
    than cores. Items are read on the driver in blocks, each broadcast by itself; keys that are null, and repeated keys, are
    left out. The result does not depend on the blocks.
    """
    spark = docs.sparkSession
    schema = f"{doc_key} long, {item_key} long, agreeing int, changed int, begins int, ends int, item_share double, _first int, _end int"
    rows, parts = [], []
    for r in items.filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(item_key, item_text).dropDuplicates([item_key]).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == block:
            parts.append(rows)
            rows = []
    parts = parts + [rows] if rows or not parts else parts
    one = len(parts) == 1

    def scanner(part):
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def scan(batches):
            held = _items_of(name, shared.value, span)
            for batch in batches:
                out = []
                keys, texts, size = [], [], 0
                for k, text in [*zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), (None, None)]:
                    if k is not None and text:
                        keys.append(k)
                        texts.append(text)
                        size += len(text)
                    elif k is not None:
                        continue
                    if texts and (size > BATCH_CHARS or k is None):
                        out += [(keys[t], held.keys[i], *rest) for t, i, *rest in _leaks_in(held, texts, one)]
                        keys, texts, size = [], [], 0
                cols = list(zip(*out)) if out else [()] * 9
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *(t for _, t in _COLUMNS)))], names=[doc_key, item_key, *(n for n, _ in _COLUMNS)])

        return spread(docs.select(F.col(doc_key).cast("long"), doc_text)).mapInArrow(scan, schema)

    found = scanner(parts[0])
    for part in parts[1:]:
        found = found.unionByName(scanner(part))
    return (found if one else found.groupBy(doc_key).applyInArrow(_explained_rows, schema)).drop("_first", "_end")


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(doc_key, item_key, agreeing, passages, item_share): one row per document and leaked item, by its best passage."""
    found = find_passages(docs, items, doc_key, doc_text, item_key, item_text, span, block)
    return found.groupBy(doc_key, item_key).agg(F.max("agreeing").alias("agreeing"), F.count("*").cast("int").alias("passages"), F.max("item_share").alias("item_share"))


def without_leaks(docs: DataFrame, passages: DataFrame, doc_key: str, doc_text: str, whole: bool = False) -> DataFrame:
    """Documents without the leaked passages (begins, ends), or without the documents that hold any.

    Overlapping and touching passages are cut out as one; documents without any, and null texts, stay as they are.
    """
    if whole:
        return docs.join(passages.select(doc_key).distinct(), doc_key, "left_anti")
    spans = passages.groupBy(doc_key).agg(F.array_sort(F.collect_list(F.struct(F.col("begins").cast("int").alias("begins"), F.col("ends").cast("int").alias("ends")))).alias("_spans"))
    text = F.col(doc_text)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def cut_out(state, s):
        kept = F.concat(state["kept"], F.substring(text, state["at"] + 1, F.greatest(s["begins"] - state["at"], F.lit(0))))
        return F.struct(kept.alias("kept"), F.greatest(state["at"], s["ends"]).alias("at"))

    left = F.aggregate("_spans", start, cut_out, lambda s: F.concat(s["kept"], F.substring(text, s["at"] + 1, F.length(text))))
    return docs.join(spans, doc_key, "left").withColumn(doc_text, F.when(F.col("_spans").isNull(), text).otherwise(left)).select(*docs.columns)
