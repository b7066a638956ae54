"""Garbled text from wrong character encodings.

The garbled forms of every distinct clean word of the corpus are generated under all encoding chains; the tokens of the
records are joined with that table on equality, and hits are verified by decoding them back. Words are runs of letters that
hold a character outside ASCII, pairs and single characters of Chinese text, and single characters outside ASCII; so words
that occur nowhere undamaged are still found by their characters. U+FFFD, which no encoding contains, is a sign by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.session import broadcast_if_small, cut

#: Encodings, by Python's names: what texts are written in, and what they are wrongly read as. Fixed values.
READ_AS = {
    "utf-8": ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1257", "koi8_r", "gbk", "big5", "gb18030", "shift_jis", "euc_kr"),
    "cp1252": ("utf-8", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1255", "cp1257", "koi8_r", "gbk", "big5", "shift_jis"),
    "gb18030": ("utf-8", "cp1252", "latin-1", "big5", "cp950", "shift_jis", "euc_kr", "cp437", "mac_roman", "cp1251"),
    "big5": ("utf-8", "cp1252", "latin-1", "gbk"),
}
#: Reading UTF-8 as one of these twice is usual.
TWICE = ("cp1252", "latin-1")
LOST = "�"
#: Lengths of the windows of a run of characters that are looked up besides whole tokens: of western and of eastern runs.
WEST, EAST = (2, 3, 4, 6), (2, 3)

# Begun only where no letter precedes and without going back, so that plain words are passed over once.
_TOKEN = r"(?:(?<![A-Za-z])[A-Za-z]*+(?:&[A-Za-z]{2,8};|[^\x00-\x7f])(?:[A-Za-z]|&[A-Za-z]{2,8};|[^\x00-\x7f])*)"
_WEST_RUN, _EAST_RUN = r"[\x{80}-\x{2e7f}\x{fffd}]{2,}", r"[\x{2e80}-\x{fffc}]{2,}"
#: Several bytes read as one character each can stand for a character of western or Chinese text; other scripts come of chance.
_EASTERN = ("gbk", "big5", "gb18030", "shift_jis", "euc_kr")
_BYTEWISE = {r for r in READ_AS["utf-8"] if r not in _EASTERN}
_USUAL = re.compile("(?:[\x00-\x7f¡-ſ‐-…€]|[一-鿿。，、；：！？（）《》“”])+")
#: Forms of single characters that no sound text holds: the second sign neither ends a word nor is a footnote mark.
_SURE_SHORT = re.compile("Ã[¡¢£¤¥¦§¨©¬¯±´µ¶¸¼½¾¿]|â€.")
_CHINESE = re.compile("[一-鿿。，、；：！？（）《》“”]+")


def wrongly_read(data: bytes, encoding: str) -> str:
    """Text that comes of reading bytes in an encoding; undefined bytes stay control characters or become U+FFFD."""
    if encoding in ("cp1250", "cp1252", "cp1253", "cp1254", "cp1255", "cp1257"):
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data) if not data.isascii() else data.decode("ascii")
    return data.decode(encoding, "replace")


def read_back(text: str, encoding: str) -> bytes | None:
    """The bytes that were read as text in an encoding; None if they can't be told."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError as e:
        if encoding in _EASTERN or text[e.start] > "\xff":
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if ord(ch) > 0xFF:
                return None
            out.append(ord(ch))
    return bytes(out)


def garbled_forms(word: str) -> Iterator[tuple[str, str]]:
    """(form, chain) of a clean word under every chain; a chain is 'written>read' or 'written>read>written>read'."""
    chinese = bool(_CHINESE.fullmatch(word))
    for written, ways in READ_AS.items():
        if written in ("gb18030", "big5") and not chinese or written == "cp1252" and chinese:
            continue
        try:
            data = word.encode(written)
        except UnicodeEncodeError:
            continue
        for read in ways:
            form = wrongly_read(data, read)
            if written == "cp1252" and read == "utf-8" and LOST not in form:
                continue  # that would be a repair
            yield form, f"{written}>{read}"
            if written == "utf-8" and read in TWICE:
                yield form.rstrip("\xa0"), f"{written}>{read}"
                for again in TWICE:
                    yield wrongly_read(form.encode("utf-8"), again), f"{written}>{read}>utf-8>{again}"
                escaped = form.replace("Ã", "&Atilde;").replace("â", "&acirc;").replace("Â", "&Acirc;")
                yield escaped, f"{written}>{read}"
                yield form.replace("Ã", "&Atilde;").replace("â", "&acirc;"), f"{written}>{read}"


def unambiguous(form: str, word: str, chain: str) -> bool:
    """Whether a form that reads back to its word proves damage by itself, however often either occurs."""
    steps = chain.split(">")
    if set(steps[::2]) != {"utf-8"} or not _BYTEWISE.issuperset(steps[1::2]) or not _USUAL.fullmatch(word):
        return False
    return len(form) >= 4 or set(steps[1::2]) <= set(TWICE) and bool(_SURE_SHORT.fullmatch(form))


def sound(word: str) -> bool:
    """Whether a word isn't itself an unambiguous form of another."""
    chains = [f"utf-8>{read}" for read in TWICE]
    before = repair(word, chains)
    return before is None or not any(unambiguous(word, before, chain) for chain in chains)


def repair(text: str, chains: list[str]) -> str | None:
    """text read back along the first chain that fits it as a whole; None if none does."""
    plain = text.replace("&Atilde;", "Ã").replace("&acirc;", "â").replace("&Acirc;", "Â")
    for chain in chains:
        steps = chain.split(">")
        now: str | None = plain
        for i in range(len(steps) - 2, -1, -2):
            data = read_back(now, steps[i + 1])
            try:
                now = data.decode(steps[i]) if data is not None else None
            except UnicodeDecodeError:
                now = None
            if now is None:
                break
        if now is not None and LOST not in now and now != text:
            return now
    return None


def _windows(runs: Column, size: int) -> Column:
    """All substrings of a length of the runs that are at least as long."""
    of_run = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - (size - 1)), lambda i: F.substring(run, i, F.lit(size)))
    return F.flatten(F.transform(F.filter(runs, lambda run: F.length(run) >= size), of_run))


def _units(text: Column) -> Column:
    """Distinct tokens and windows of a text that hold a character outside ASCII or an entity."""
    tokens = F.regexp_extract_all(text, F.lit("(" + _TOKEN + ")"), F.lit(1))
    west = F.array_distinct(F.regexp_extract_all(text, F.lit("(" + _WEST_RUN + ")"), F.lit(1)))
    east = F.array_distinct(F.regexp_extract_all(text, F.lit("(" + _EAST_RUN + ")"), F.lit(1)))
    # Tokens that are whole clauses of Chinese text are no words; their windows stand for them.
    words = F.filter(tokens, lambda t: ~t.rlike(r"[\x{2e80}-\x{fffc}]{4}"))
    return F.array_distinct(F.concat(words, *[_windows(west, n) for n in WEST], *[_windows(east, n) for n in EAST]))


def _characters(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([^\x00-\x7f])"), F.lit(1)))


def garbled_table(vocabulary: DataFrame) -> DataFrame:
    """(form, word, chain, kind, reads_back) from (unit, as_char, n): forms of the units, with n of the word as weight.

    as_char marks units that are characters within words; of those only forms of UTF-8 read byte by byte tell anything.
    sure marks forms that prove damage whatever the counts, sound words that are no such forms.
    kind is 'east' for forms of few Chinese characters, which prove little alone, else 'west'. Forms equal to their word and
    forms within ASCII are left out. Words of more than 60 characters and Chinese ones of more than two make no forms: their
    characters and pairs do.
    """
    schema = "form string, word string, chain string, weight long, kind string, reads_back boolean, sure boolean, sound boolean"

    def forms(batches):
        for batch in batches:
            rows = []
            for word, as_char, n in zip(*(c.to_pylist() for c in batch.columns)):
                if word.isascii() or LOST in word or len(word) > 60 or re.search(r"&[A-Za-z]{2,8};|[\x80-\x9f]", word):
                    continue
                chinese = bool(_CHINESE.fullmatch(word))
                if chinese and len(word) > 2:
                    continue
                whole = sound(word)
                for form, chain in set(garbled_forms(word)):
                    if form == word or form.isascii() and "&" not in form:
                        continue
                    if as_char and (not chain.startswith("utf-8") or len(form) < 2 or any(ord(c) > 0x2E7F for c in form)):
                        continue
                    if chinese and len(form) < (2 if len(word) == 2 else 3):
                        continue
                    east = all(ord(c) > 0x2E7F for c in form)
                    back = LOST not in form and repair(form, [chain]) == word
                    rows.append((form, word, chain, n, "east" if east and len(form) < 6 else "west", back, back and whole and unambiguous(form, word, chain), whole))
            yield pa.RecordBatch.from_pylist([dict(zip(("form", "word", "chain", "weight", "kind", "reads_back", "sure", "sound"), r)) for r in rows], schema=_TABLE)

    return vocabulary.select("unit", "as_char", "n").mapInArrow(forms, schema)


_TABLE = pa.schema([("form", pa.string()), ("word", pa.string()), ("chain", pa.string()), ("weight", pa.int64()), ("kind", pa.string()), ("reads_back", pa.bool_()), ("sure", pa.bool_()), ("sound", pa.bool_())])


@F.arrow_udf(T.StringType())
def _restore(text: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for value, found in zip(text.to_pylist(), hits.to_pylist()):
        chains: dict[str, int] = {}
        words = {}
        some = any(h["sound"] for h in found)
        for h in found:
            if some and not h["sound"]:
                continue
            chains[h["chain"]] = chains.get(h["chain"], 0) + 1
            if h["reads_back"]:
                words.setdefault(h["form"], h["word"])
        order = sorted(chains, key=lambda c: (-chains[c], c))
        whole = repair(value, order[:1]) if not value.isascii() else None
        if whole is not None and not sound(whole):
            whole = repair(whole, [f"utf-8>{read}" for read in TWICE])
        if whole is not None and not any(f in whole for f in words):
            out.append(whole)
            continue
        done = value
        for form in sorted(words, key=lambda f: (-len(f), f)):
            done = done.replace(form, words[form])
        out.append(done if done != value and LOST not in done else None)
    return pa.array(out, pa.string())


def find_garbled(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, hits, lost): one row per damaged value, wholly or in part, with the garbled forms found in it.

    Forms count that read back to their word along their chain. A value with U+FFFD, which no encoding contains, is damaged
    beyond reading back at that place: it comes out with lost true, its hits being all forms met, also those with U+FFFD. df
    may hold a key several times with equal values; each damaged (key, field) comes out once. Null and empty values are
    sound. Vocabulary and weights are counted over all rows. An empty table gives no rows.
    """
    values = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("_v")).select(key, "_v.field", "_v.text")
    odd = values.filter(F.col("text").rlike(r"[^\x00-\x7f]|&[A-Za-z]{2,8};"))
    units = cut(odd.select(key, "field", _units(F.col("text")).alias("units"), _characters(F.col("text")).alias("characters")), "units")
    counted = [units.select(F.explode(c).alias("unit"), F.lit(c == "characters").alias("as_char")) for c in ("units", "characters")]
    vocabulary = cut(counted[0].unionByName(counted[1]).groupBy("unit", "as_char").agg(F.count("*").alias("n")), "vocabulary")
    table = garbled_table(vocabulary.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "unit"))
    # Forms that occur, less often than the word they come from unless they are sure; of several words a sure
    # one, then the most usual one.
    met = table.join(vocabulary.filter("NOT as_char").select(F.col("unit").alias("form"), F.col("n").alias("met")), "form").filter((F.col("weight") >= F.col("met")) | F.col("sure"))
    met = met.filter(F.col("reads_back") | F.col("form").contains(LOST))
    best = met.groupBy("form").agg(F.max_by(F.struct("word", "chain", "kind", "reads_back", "sound"), F.struct("sure", "weight", "word", "chain")).alias("_b")).select("form", "_b.*")
    known = broadcast_if_small(cut(best, "garbled"))
    seen = units.select(key, "field", F.explode("units").alias("form"))
    hits = seen.join(known, "form").groupBy(key, "field").agg(F.collect_list(F.struct("form", "word", "chain", "kind", "reads_back", "sound")).alias("hits"))
    lost = units.filter(F.exists("units", lambda u: u.contains(LOST))).select(key, "field").distinct().withColumn("lost", F.lit(True))
    # A short form in Chinese characters may be a chance; two in one value are not.
    verified = lambda kind: F.size(F.filter("hits", lambda h: h["reads_back"] & (h["kind"] == kind)))
    enough = hits.filter((verified("west") >= 1) | (verified("east") >= 2) | F.exists("hits", lambda h: h["form"].contains(LOST)))
    return enough.join(lost, [key, "field"], "full_outer").select(key, "field", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"), F.coalesce("lost", F.lit(False)).alias("lost")).dropDuplicates([key, "field"])


def repair_garbled(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text, restored): the damaged values with the original text, null where it can't be told."""
    found = find_garbled(df, key, fields)
    values = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("_v")).select(key, "_v.field", "_v.text")
    both = values.join(found, [key, "field"]).dropDuplicates([key, "field", "text"])
    return both.select(key, "field", "text", _restore("text", "hits").alias("restored"))
