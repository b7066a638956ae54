"""Mapping freely typed values to a canonical list: a trie of the reference entries searched with a Levenshtein automaton.

The trie holds every canonical entry and, as alias paths, the labels that lead to one (through any chain of rules). A value
is rewritten by a few rules on notation (quotes, list marks, bracketed notes, inversions, plurals); every rewriting is run
through the trie together with an automaton that accepts strings within a distance that depends on the value's length, with
adjacent transpositions as one edit. All entries within the distance are returned; the nearest one is the match. The distance
is 0 for texts of less than 5 characters, 1 for less than 11, else 2.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.normal import normal_form

#: Reference entries and labels searched by one trie; a longer list is searched block by block.
BLOCK = 50_000

#: Words of keywords at large that say only that a text is about the term, and head nouns that add nothing to a term
#: ("use of X systems"). Fixed values; parameters of map_values.
ABOUT = ("study", "studies", "survey", "case", "review", "case study", "overview", "a review", "a survey")
LIGHT = ("schemes", "systems", "projects", "programmes", "programs", "measures", "technologies", "applications")


def allowed_distance(length: int) -> int:
    """Edits allowed for a value of so many characters."""
    return 0 if length < 5 else 1 if length < 11 else 2


class Trie:
    """Reference strings with their canonical entries; '' stands for a deleted term."""

    def __init__(self, paths: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for text, entry in sorted(set(paths)):
            node = self.root
            for ch in text:
                node = node.setdefault(ch, {})
            node.setdefault(None, []).append((text, entry))

    def exact(self, text: str) -> list[tuple[str, str]]:
        node = self.root
        for ch in text:
            node = node.get(ch)
            if node is None:
                return []
        return node.get(None, [])

    def within(self, text: str, most: int) -> list[tuple[int, str, str]]:
        """(distance, reference string, entry) of all paths within `most` edits (insert, delete, replace, swap neighbours)."""
        if most == 0:
            return [(0, *hit) for hit in self.exact(text)]
        masks: dict[str, int] = {}
        for i, ch in enumerate(text):
            masks[ch] = masks.get(ch, 0) | 1 << (i + 1)
        full, end = (1 << (len(text) + 1)) - 1, 1 << len(text)
        # State j: bit i is set where the first i characters of text match the path so far with at most j edits. The states
        # of one character before serve swapped neighbours. Written out for up to two edits, which is what distances allow.
        if most > 2:
            raise ValueError("at most two edits")
        two = most == 2
        found: list[tuple[int, str, str]] = []
        stack = [(self.root, 1, 3 & full, 7 & full if two else 0, 0, 0, 0)]
        push, pop, get = stack.append, stack.pop, masks.get
        while stack:
            node, s0, s1, s2, b0, b1, last = pop()
            for ch, child in node.items():
                if ch is None:
                    d = 0 if s0 & end else 1 if s1 & end else 2 if s2 & end else 3
                    if d <= most:
                        found += [(d, *hit) for hit in child]
                    continue
                mask = get(ch, 0)
                n0 = (s0 << 1) & mask
                n1 = (((s1 << 1) & mask) | s0 | (s0 << 1) | (n0 << 1) | ((((b0 << 1) & mask) << 1) & last)) & full
                if two:
                    n2 = (((s2 << 1) & mask) | s1 | (s1 << 1) | (n1 << 1) | ((((b1 << 1) & mask) << 1) & last)) & full
                    if n2:
                        push((child, n0, n1, n2, s0, s1, mask))
                elif n1:
                    push((child, n0, n1, 0, s0, s1, mask))
        return found

    def abbreviated(self, text: str) -> set[str]:
        """Entries of the paths whose words begin with the words of text, where a word ending in '.' may be cut short."""
        nodes = [self.root]
        for word in text.split(" "):
            cut = word.endswith(".")
            stem = word[:-1] if cut else word
            if cut and len(stem) < 3:
                return set()
            reached = []
            for node in nodes:
                for ch in (" " + stem if node is not self.root else stem):
                    node = node.get(ch)
                    if node is None:
                        break
                else:
                    todo = [node]
                    while todo:
                        x = todo.pop()
                        reached.append(x)
                        if cut:
                            todo += [c for ch, c in x.items() if ch is not None and ch != " "]
            nodes = reached
        return {entry for node in nodes for _, entry in node.get(None, [])}


def singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("sses", "shes", "ches", "xes", "uses")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


_OUTER = " \t\n\r*#\"'`‘’“”«»„;,.:!?·•"
_NOTE = re.compile(r"\s*(\[[^\]]*\]|\{[^}]*\})\s*$")
_PAREN = re.compile(r"^(.*?)\s*\(([^()]*)\)\s*$")
_INVERTED = re.compile(r"^(.+?)(?:\s*,\s+|\s+[-–—]\s+)(.+)$")
_LINKED = re.compile(r"^(.+?) (?:of|in|for|on|at) (?:the )?(.+)$")
_PLAIN_DASH = re.compile(r"\s+[-–—]\s+")


def rewritings(value: str, about: tuple[str, ...] = ABOUT, light: tuple[str, ...] = LIGHT) -> list[str]:
    """Normalised readings of a typed value, the most literal first."""
    text = unicodedata.normalize("NFKC", value).strip(_OUTER).lower()
    out: dict[str, None] = {}

    def add(x: str) -> None:
        x = normal_form(x.strip(_OUTER))
        if x:
            out.setdefault(x, None)

    def bare(x: str) -> Iterator[str]:
        yield x
        m = _PAREN.match(x)
        if m and m[1]:
            inner = m[2].strip()
            initials = "".join(w[0] for w in re.split(r"[\s\-]+", m[1]) if w)
            if inner in about or inner.replace(".", "") == initials:
                yield from bare(m[1])
            else:
                yield from bare(f"{m[1]} {inner}")
        m = _NOTE.search(x)
        if m and x[: m.start()]:
            yield from bare(x[: m.start()])
        head, sep, tail = x.rpartition(":")
        if sep and normal_form(tail) in about:
            yield from bare(head)
        for word in about:
            if x.endswith(" " + word):
                yield from bare(x[: -len(word) - 1])
            if x.startswith(word + " of "):
                yield from bare(x[len(word) + 4 :])
        if x.startswith(("the ", "a ", "an ")):
            yield from bare(x.split(" ", 1)[1])

    for x in bare(text):
        add(x)
        m = _INVERTED.match(x)
        if m:
            add(f"{m[2]} {m[1]}")
        m = _LINKED.match(_PLAIN_DASH.sub(" ", x))
        if m:
            words = m[2].strip(_OUTER).split(" ")
            if len(words) > 1 and words[-1] in light:
                words = words[:-1]
            add(" ".join([*words[:-1], singular(words[-1])]) + " " + m[1])
    for x in list(out):
        words = x.split(" ")
        add(" ".join([*words[:-1], singular(words[-1])]))
        add(" ".join(map(singular, words)))
    return list(out)


def _edits(a: str, b: str) -> int:
    """Edit distance with adjacent transpositions."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(one[j] + (x != y), one[j + 1] + 1, row[j] + 1)
            if two is not None and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, two[j - 1] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def _same_words(a: str, b: str) -> bool:
    """Whether each word stays recognisable: two edits only in words of seven letters, or of four with the same first or last one."""
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return a.replace(" ", "") == b.replace(" ", "") or _edits(a, b) <= 2 and abs(len(x) - len(y)) == 1 and _edits(a.replace(" ", ""), b.replace(" ", "")) <= 1

    def allowed(p: str, q: str) -> int:
        short = min(len(p), len(q))
        return 0 if max(len(p), len(q)) < 3 else 2 if short >= 7 or short >= 4 and (p[0] == q[0] or p[-1] == q[-1]) else 1

    return all(p == q or _edits(p, q) <= allowed(p, q) for p, q in zip(x, y))


#: How a reference path was met: as a reading itself, by abbreviated words, within the distance.
SAME, ABBREVIATED, NEAR = 0, 1, 2


def candidates(trie: Trie, value: str, about: tuple[str, ...] = ABOUT, light: tuple[str, ...] = LIGHT, every: bool = True) -> list[tuple[int, int, str, str]]:
    """(how, rank, path, entry) of the reference paths met by the readings of a value.

    rank is the reading's place for paths that are a reading themselves, else the distance. Without `every` the automaton is
    not asked for values that a reading settles, whose nearest entry is then known.
    """
    forms = rewritings(value, about, light)
    found = [(SAME, i, *hit) for i, form in enumerate(forms) for hit in trie.exact(form)]
    if not every and nearest(found):
        return found
    if "." in value:
        short = normal_form(unicodedata.normalize("NFKC", value).strip(_OUTER.replace(".", "")).lower())
        found += [(ABBREVIATED, 1, short, entry) for entry in trie.abbreviated(short)]
        if not every and nearest(found):
            return found
    near: dict[tuple[str, str], int] = {}
    for form in forms:
        for distance, text, entry in trie.within(form, allowed_distance(len(form))):
            if distance < near.get((text, entry), 9) and (distance == 0 or _same_words(form, text)):
                near[text, entry] = distance
    return found + [(NEAR, d, text, entry) for (text, entry), d in near.items()]


def nearest(found: Iterable[tuple[int, int, str, str]]) -> tuple[int, str] | None:
    """(distance, entry) of what the candidates mean, None if nothing or if several are equally near.

    The most literal reading that is a path of one entry; else the one entry that abbreviated words lead to; else the nearest.
    """
    levels: dict[tuple[int, int], set[str]] = {}
    for how, rank, _, entry in found:
        levels.setdefault((how, rank), set()).add(entry)
    for (how, rank), entries in sorted(levels.items()):
        if len(entries) == 1:
            return 0 if how == SAME else rank, min(entries)
        if how == NEAR:
            return None
    return None


def match(trie: Trie, value: str) -> tuple[int, str] | None:
    """(distance, entry) of the nearest reference entry, None if there is none or several are equally near."""
    return nearest(candidates(trie, value, every=False))


def reference_paths(rules: Iterable[tuple[str | None, str | None]]) -> tuple[list[tuple[str, str]], set[str]]:
    """Alias paths (normal form of label or entry, canonical entry or '') and the canonical entries, from (label, replace_by).

    Later rules win. Canonical are the trimmed, non-blank replace_by values that no rule leads to another value. A cycle of
    rules ends in its smallest member; a blank replace_by deletes the label; blank labels are ignored.
    """
    lead: dict[str, str] = {}
    values: set[str] = set()
    for label, target in rules:
        label, target = (label or "").strip(), (target or "").strip()
        if target:
            values.add(target)
        if label:
            lead[label] = target
    canonical = {v for v in values if not lead.get(v) or lead[v] == v}

    def end(label: str) -> str:
        seen = [label]
        while (to := lead.get(seen[-1])) is not None and to != seen[-1]:
            if to == "":
                return ""
            if to in seen:
                return min(seen[seen.index(to) :])
            seen.append(to)
        return seen[-1]

    paths = {(normal_form(c), c) for c in canonical}
    for label in lead:
        to = end(label)
        # A label that reads like a canonical entry means that entry.
        if to != label or label in canonical:
            paths.add((normal_form(label), to))
    own = {text for text, entry in paths if entry in canonical and normal_form(entry) == text}
    return sorted((t, e) for t, e in paths if t and not (t in own and normal_form(e) != t)), canonical


def _parts(rules: DataFrame, label: str, target: str, order: tuple[str, ...], block: int) -> tuple[list[list[tuple[str, str]]], set[str]]:
    """The reference paths in blocks, and the canonical entries; the list is read on the driver."""
    rows = rules.orderBy(*order).select(label, target) if order else rules.select(label, target)
    paths, canonical = reference_paths((r[0], r[1]) for r in rows.toLocalIterator())
    return [paths[i : i + block] for i in range(0, len(paths), block)] or [[]], canonical


_tries: dict[str, Trie] = {}


def _trie_of(name: str, paths: list[tuple[str, str]]) -> Trie:
    """The trie of a broadcast, built once per worker."""
    if name not in _tries:
        _tries.clear()
        _tries[name] = Trie(paths)
    return _tries[name]


def _candidate_rows(values: DataFrame, parts: list, about: tuple[str, ...], light: tuple[str, ...]) -> DataFrame:
    """(value, how, rank, path, entry): every candidate of each non-null value, over all blocks."""
    spark, out = values.sparkSession, None
    schema = pa.schema([("value", pa.string()), ("how", pa.int32()), ("rank", pa.int32()), ("path", pa.string()), ("entry", pa.string())])

    def searcher(part):
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def search(batches):
            trie = _trie_of(name, shared.value)
            for batch in batches:
                rows = [(x, *hit) for x in batch.column(0).to_pylist() if x is not None for hit in candidates(trie, x, about, light)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, schema)], schema=schema)

        return values.select("value").mapInArrow(search, "value string, how int, rank int, path string, entry string")

    for part in parts:
        out = searcher(part) if out is None else out.unionByName(searcher(part))
    return out


def map_candidates(values: DataFrame, rules: DataFrame, label: str = "label", target: str = "replace_by", order: tuple[str, ...] = (), block: int = BLOCK, about: tuple[str, ...] = ABOUT, light: tuple[str, ...] = LIGHT) -> DataFrame:
    """(value, entry, path, distance): all entries within the distance of a reading of each distinct value, with the path met.

    entry is '' where the path is that of a deleted term. Values without any, and null ones, have no rows. distance is null
    where abbreviated words led to the entry.
    """
    rows = _candidate_rows(values.select("value").distinct(), _parts(rules, label, target, order, block)[0], about, light)
    distance = F.when(F.col("how") == SAME, 0).when(F.col("how") == NEAR, F.col("rank"))
    return rows.groupBy("value", "entry", "path").agg(F.min(distance).alias("distance"))


def map_values(values: DataFrame, rules: DataFrame, label: str = "label", target: str = "replace_by", order: tuple[str, ...] = (), block: int = BLOCK, about: tuple[str, ...] = ABOUT, light: tuple[str, ...] = LIGHT) -> DataFrame:
    """(value, entry, distance, is_canonical): one row per row of values, a table of one string column 'value'.

    entry is the canonical entry meant, '' where there is none or the value means a deleted term; is_canonical tells whether
    the value is character for character a canonical entry. Null values come out with an empty entry. The reference list is
    read on the driver; it is searched in blocks of `block` paths, each broadcast by itself. Over several blocks the
    candidates of all are brought together before one is chosen, so that the result does not depend on the blocks.
    """
    parts, canonical = _parts(rules, label, target, order, block)
    schema = "value string, entry string, distance int, is_canonical boolean"
    spark = values.sparkSession
    if len(parts) == 1:
        shared, name = spark.sparkContext.broadcast((parts[0], canonical)), uuid.uuid4().hex

        def search(batches):
            some, known = shared.value
            trie = _trie_of(name, some)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                hits = [(nearest(candidates(trie, x, about, light, False)) if x is not None and x not in known else None) for x in texts]
                yield pa.record_batch(
                    {
                        "value": batch.column(0).cast(pa.string()),
                        "entry": pa.array([x if x in known else h[1] if h else "" for x, h in zip(texts, hits)], pa.string()),
                        "distance": pa.array([0 if x in known else h[0] if h else None for x, h in zip(texts, hits)], pa.int32()),
                        "is_canonical": pa.array([x in known for x in texts], pa.bool_()),
                    }
                )

        return values.select("value").mapInArrow(search, schema)

    @F.arrow_udf("struct<entry: string, distance: int>")
    def choose(found: pa.Array) -> pa.Array:
        hits = [nearest([(r["how"], r["rank"], r["path"], r["entry"]) for r in rows or ()]) for rows in found.to_pylist()]
        return pa.array([{"entry": h[1] if h else "", "distance": h[0] if h else None} for h in hits], pa.struct([("entry", pa.string()), ("distance", pa.int32())]))

    rows = _candidate_rows(values.select("value").distinct(), parts, about, light)
    chosen = rows.groupBy("value").agg(F.collect_list(F.struct("how", "rank", "path", "entry")).alias("found")).select("value", choose("found").alias("_c")).select("value", "_c.*")
    known = spark.createDataFrame([(c,) for c in sorted(canonical)], "value string").withColumn("is_canonical", F.lit(True))
    joined = values.select("value").join(chosen, "value", "left").join(known, "value", "left")
    same = F.coalesce("is_canonical", F.lit(False))
    return joined.select("value", F.when(same, F.col("value")).otherwise(F.coalesce("entry", F.lit(""))).alias("entry"), F.when(same, 0).otherwise(F.col("distance")).alias("distance"), same.alias("is_canonical"))
