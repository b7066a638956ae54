"""Variant spellings of names: canonical rewritings, exploded and equi-joined.

Each distinct spelling is rewritten into canonical forms: token order (``Given Surname``, ``Surname, Given``, ``Surname GM``),
nicknames to formal names, initials, legal forms and abbreviated words of institutions, folded accents and case, second
surnames, and forms with one letter left out for typing errors. Forms are exploded into rows and joined on equality; a link
is scored by how rare its rewriting is: by one over the number of authors, counted before linking, that it may mean.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.mapping import _edits
from termweave.session import cut

#: Nicknames and the formal names they stand for. Fixed values.
NICKNAMES = """
abby abigail; al albert alan; alex alexander alexandra; andy andrew; angie angela; annie anne anna; art arthur; barb barbara;
becky rebecca; bella isabella; ben benjamin; benny benjamin; bernie bernard; bert albert robert; beth elizabeth; betsy elizabeth;
betty elizabeth; bill william; billy william; bob robert; bobby robert; brad bradley; cathy catherine katherine; charlie charles;
chris christopher christine; chuck charles; cindy cynthia; dan daniel; danny daniel; dave david; deb deborah; debbie deborah;
dick richard; dom dominic; don donald; dora theodora; doug douglas; ed edward; eddie edward; ellie eleanor; eliza elizabeth;
fred frederick; freddie frederick; gabe gabriel; gene eugene; greg gregory; hal harold; hank henry; hattie harriet; izzy isabella;
jack john; jake jacob; jamie james; jeff jeffrey; jen jennifer; jenny jennifer; jerry gerald; jess jessica; jim james; jo josephine;
joe joseph; josie josephine; kate katherine catherine; kathy katherine kathleen; ken kenneth; kit christopher; larry lawrence;
len leonard; lenny leonard; leo leonard; libby elizabeth; liz elizabeth; lizzie elizabeth; lou louis louise; maggie margaret;
matt matthew; meg margaret; mick michael; mike michael; molly mary; nan nancy; nate nathaniel; ned edward; nell helen; nick nicholas;
nicky nicholas; ollie oliver; pat patrick patricia; peggy margaret; pete peter; phil philip; pip philippa; pippa philippa; ray raymond;
rick richard; rob robert; ron ronald; ros rosalind; rosie rosalind; roz rosalind; sally sarah; sam samuel samantha; sandy alexander;
sue susan susanna; susie susanna susan; ted edward theodore; teddy edward theodore; terry terence; theo theodore theodora;
tim timothy; tom thomas; tommy thomas; tony anthony; trish patricia; vic victor victoria; vicky victoria; vickie victoria;
walt walter; will william; zach zachary; zack zachary; zak zachary
"""
_FORMAL = {words[0]: words[1:] for words in (x.split() for x in NICKNAMES.split(";"))}

#: Words that name a kind of institution, words that only join, and particles of surnames. Fixed values.
ORG_WORDS = ("institute", "institut", "institution", "university", "laboratory", "consortium", "council", "center", "centre", "department", "ministry", "society", "association", "academy", "college", "school", "museum", "foundation", "company", "corporation", "gmbh", "dept")
JOINING = {"of", "for", "the", "and", "on", "at", "in", "von", "de", "und", "et"}
PARTICLES = {"van", "von", "de", "der", "den", "da", "di", "du", "la", "le", "al", "el", "ter", "ten", "dos", "das", "mac", "st"}
#: Legal forms of firms, which a name may have or not; the short ones may also be a person's initials. Fixed values.
LEGAL = {"ltd", "limited", "inc", "incorporated", "corp", "corporation", "company", "gmbh", "plc", "llc", "llp", "pty", "sarl", "srl", "spa", "sas", "aps", "oyj", "kgaa", "ohg", "mbh"}
LEGAL_SHORT = {"ag", "sa", "ab", "as", "nv", "bv", "kg", "se", "oy", "sl", "co", "ug", "ev", "eg", "lp"}

_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})

#: Letters of a word that abbreviations of institutions keep.
BEGINNING = 3

PARSED = "name string, n long, reading int, kind string, family string, given string, middle string, firm boolean, initials string, forms array<string>, short string"


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(_LETTERS)) if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def _is_type(word: str) -> bool:
    """Whether a word names a kind of institution: in full, with one slip, or abbreviated to three letters or more."""
    return len(word) >= 3 and any(w.startswith(word) or len(word) > 5 and abs(len(w) - len(word)) <= 1 and len(set(w) ^ set(word)) <= 2 and _edits(w, word) <= 1 for w in ORG_WORDS)


_ANY_LEGAL = LEGAL | LEGAL_SHORT
_JOINING_LETTERS = {frozenset(w) for w in JOINING}


def _joins(word: str) -> bool:
    """Whether a word only joins others, also with letters swapped or doubled."""
    return word in JOINING or len(word) <= 4 and frozenset(word) in _JOINING_LETTERS and not _is_type(word)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?", text)


def _firm(text: str) -> tuple[str, bool] | None:
    """(name without its legal form, whether the legal form may be a person's initials) of a firm; None for other names."""
    if not text or text.rsplit(None, 1)[-1].replace(".", "").lower() not in _ANY_LEGAL:
        return None
    plain = re.sub(r"\b(\w)\.(?=\w\b)|(?<=\b\w)\.(?!\w)", r"\1", fold(text).replace("&", " and "))
    words = [w.strip(".") for w in re.findall(r"[^\W_]+(?:[-’'][^\W_]+)*\.?", plain)]
    end = len(words)
    while end > 1 and (words[end - 1] in LEGAL or words[end - 1] in LEGAL_SHORT or words[end - 1] == "and" and end < len(words)):
        end -= 1
    legal = [w for w in words[end:] if w != "and"]
    if not legal or not words[0]:
        return None
    # One short legal form after one word, as in 'Surname AG', may be initials; a comma before it makes it a given name.
    unsure = len(legal) == 1 and legal[0] in LEGAL_SHORT
    if unsure and ("," in text or end > 1 and words[end - 2] != "and" and "and" not in words[:end]):
        return None
    return " ".join(w for w in words[:end] if not _joins(w)), unsure and end == 1


def _org(name: str) -> tuple[str, list[str]] | None:
    """(place, other words) of an institution, None where the name looks like a person's."""
    text = fold(name)
    plain = _words(text)
    if len(plain) < 3:
        return None
    words = [w.rstrip(".") for w in plain]
    cues = sum(map(_is_type, words))
    abbreviated = sum(w.endswith(".") and len(w) > 3 for w in plain)
    joined = any(w in ("of", "for") or len(w) <= 4 and set(w) in ({"o", "f"}, {"f", "o", "r"}) for w in words)
    if not (joined and len(words) >= 4 or "(" in text or abbreviated >= 2 or cues and len(words) >= 4):
        return None
    found = re.search(r"\(([^()]+)\)\s*$", text)
    content = [w for w, p in zip(words, plain) if len(w) > 2 and (p.endswith(".") or not _joins(w))]
    if len(content) < 2:
        return None
    if found:
        place = fold(found[1]).strip()
    elif "," in text:
        place = text.rsplit(",", 1)[1].strip(" .")
    elif words[0] == "the":
        place = content[0]
    elif _is_type(content[0]) and not _is_type(content[-1]) and not plain[-1].endswith("."):
        place = content[-1]
    else:
        place = content[0]
    rest = list(content)
    for w in re.findall(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*", place):
        if w in rest:
            rest.remove(w)
    return place, sorted(rest)


def _readings(name: str) -> list[tuple]:
    """(kind, family, given, middle, firm, initials) of the ways to read a name; given is '' where only initials are known."""
    text = " ".join(unicodedata.normalize("NFC", name).split()).strip(" ;")
    firm_name = _firm(text)
    if firm_name and not firm_name[1]:
        return [("firm", firm_name[0], "", "", True, "")]
    org = _org(text)
    if org:
        return [("org", org[0], " ".join(org[1]), "", True, "")]
    if firm_name:
        # Both ways: which one holds is told by whether others bear the family name.
        return [*_persons(text), ("firm?", firm_name[0], "", "", False, "")]
    return _persons(text)


def _persons(text: str) -> list[tuple]:
    """The ways to read a person's name."""
    text = re.sub(r"(?<=[^\W\d_]{2})\.$", "", text)
    full = lambda w: len(w.strip(".")) >= 2 and not re.fullmatch(r"(?:[^\W\d_]\.){2,}", w)

    def person(family: list[str], rest: list[str], firm: bool, letters: str = "") -> tuple | None:
        family_text = fold(" ".join(family)).strip(" .,")
        if not family_text:
            return None
        if letters:
            return ("person", family_text, "", letters[1:2], firm, letters)
        if not rest:
            return ("person", family_text, "", "", firm, "")
        first = fold(rest[0]).strip(".")
        others = "".join(fold(w).strip(".")[:1] for w in rest[1:])
        if not full(rest[0]):
            letters = "".join(c for w in rest for c in re.findall(r"[^\W\d_]", fold(w))[: 1 if full(w) else 3])
            return ("person", family_text, "", letters[1:2], firm, letters)
        return ("person", family_text, first, others[:1], firm, first[:1] + others)

    if "," in text:
        left, right = text.split(",", 1)
        rest = right.replace(",", " ").split()
        if len(rest) == 1 and 1 < len(rest[0]) <= 3 and rest[0].isupper() and rest[0].isalpha():
            return [x for x in [person(left.split(), [], True, fold(rest[0]))] if x]
        return [x for x in [person(left.split(), rest, True)] if x]
    words = text.split()
    if len(words) <= 1:
        return [x for x in [person(words, [], True)] if x]
    tail = words[-1].replace(".", "")
    if not full(words[0]):
        k = next((i for i, w in enumerate(words) if full(w)), len(words))
        return [x for x in [person(words[k:], [], True, fold("".join(words[:k]).replace(".", "")))] if x]
    if tail.isalpha() and tail.isupper() and (len(tail) == 1 or len(tail) <= 3 and ("." in words[-1] or not text.isupper())):
        return [x for x in [person(words[:-1], [], True, fold(tail))] if x]
    out = []
    middle = [i for i, w in enumerate(words) if not full(w)]
    if middle:  # Given M. Surname
        k = middle[-1] + 1
        return [x for x in [person(words[k:], words[:k], True)] if x]
    out.append(person(words[:-1], words[-1:], False))
    out.append(person(words[1:], words[:1], False))
    if fold(words[0]) in PARTICLES:
        out = out[:1]
    elif len(words) > 2 and fold(words[1]) in PARTICLES:
        out = out[1:]
    return [x for x in out if x]


def _formals(given: str) -> list[str]:
    return [given, *_FORMAL.get(given, [])]


def parse_names(names: DataFrame) -> DataFrame:
    """Readings of each (name, n); forms are the canonical texts 'family|given', one per formal name that given may stand for."""

    def parse(batches):
        for batch in batches:
            out: list[tuple] = []
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (kind, family, given, middle, firm, initials) in enumerate(_readings(name)):
                    if kind.startswith("firm"):
                        forms, short = [f"{family}|"], ""
                    elif kind == "org":
                        forms, short = [f"{family}|{given}"], f"{family}|" + " ".join(sorted(w[:BEGINNING] for w in given.split()))
                    else:
                        forms, short = [f"{family}|{g}" for g in _formals(given)] if given else [], f"{family}|{initials[:1]}"
                    out.append((name, n, i, kind, family, given, middle, firm, initials, forms, short))
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, row)) for row in out], schema=_SCHEMA)

    return names.select("name", "n").mapInArrow(parse, PARSED)


_FIELDS = [x.split()[0] for x in PARSED.split(", ")]
_SCHEMA = pa.schema([(f, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}.get(x.split()[1], pa.string())) for f, x in zip(_FIELDS, PARSED.split(", "))])


def _best(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each key with the greatest order, as an aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_b")).select(*keys, "_b.*")


def _shortened(col: Column) -> Column:
    """The text itself and every text with one character left out."""
    left_out = F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.length(col))))
    return F.array_distinct(F.concat(F.array(col), left_out))


def one_edit(a: Column, b: Column) -> Column:
    """For texts that share a form with at most one character left out: whether one is the other with one typing error."""
    swapped = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | swapped


def link_names(names: DataFrame) -> DataFrame:
    """(name, entity, rule, score): one row per distinct name, from (name, n) with how often each occurs.

    entity is the canonical form of the author a name means; names with one entity mean the same author. rule names the
    rewriting that made the link; score is 1 over the number of authors that the rewriting may mean, counted before linking:
    those that a nickname, a typing error or initials may stand for, and as many more as bear the same family and given name
    by chance. A name whose initials fit several authors, or none, is an entity of its own, together with equal forms. A legal form alone
    makes no difference between firms; 'Surname AG' is a person where others bear the family name. Null and blank names are
    left out; an empty table gives no rows.
    """
    readings = cut(parse_names(names.filter(F.trim("name") != "")), "readings")

    # Token order: of two readings the one whose given name, or what it is a nickname of, is the more usual one.
    usual = readings.filter("firm AND kind = 'person' AND given <> ''").groupBy("given").agg(F.count_distinct("family").alias("usual"))
    open_ = readings.filter("NOT firm").select("name", "reading", F.explode("forms").alias("form")).withColumn("given", F.substring_index("form", "|", -1))
    known = open_.join(usual, "given").groupBy("name", "reading").agg(F.max("usual").alias("usual"))
    # 'Surname AG' is a firm where no other name has that family.
    borne = readings.join(readings.filter("kind = 'firm?'").select("name").distinct(), "name", "left_anti").filter("kind = 'person'").select("family").distinct().withColumn("borne", F.lit(True))
    sure = readings.filter("kind = 'firm?'").select("name", "reading", "family").join(borne, "family", "left").filter("borne IS NULL").select("name", "reading", F.lit(True).alias("alone"))
    ranked = readings.join(known, ["name", "reading"], "left").join(sure, ["name", "reading"], "left").withColumn("usual", F.coalesce("usual", F.lit(0)))
    ranked = ranked.withColumn("kind", F.regexp_replace("kind", r"\?", ""))
    read = _best(ranked, ["name"], [F.coalesce("alone", F.lit(False)), F.col("firm"), F.col("usual"), F.size("forms"), -F.col("reading")], ["n", "kind", "family", "given", "middle", "initials", "forms", "short"])
    read = cut(read, "read")

    # Nicknames: of the formal names the one that occurs with this family as such.
    full = read.filter(F.size("forms") > 0)
    plain = full.select(F.col("forms")[0].alias("form"), "n").groupBy("form").agg(F.sum("n").alias("support"))
    options = full.select("name", F.posexplode("forms").alias("i", "form")).join(plain, "form", "left").withColumn("support", F.coalesce("support", F.lit(0)))
    # A formal name goes before the nickname itself where it occurs; unsupported formal names only where nothing else is known.
    formed = _best(options, ["name"], [(F.col("i") > 0) & (F.col("support") > 0), F.col("i") == 0, F.col("support"), F.col("form")], ["form", "i"])
    meant = options.groupBy("name").agg(F.count_if((F.col("i") > 0) & (F.col("support") > 0)).alias("meant"))
    full = full.join(formed, "name").join(meant, "name").withColumn("given", F.substring_index("form", "|", -1))
    families = read.groupBy("kind", "family").agg(F.count("*").alias("spellings"))
    givens = full.filter("kind = 'person'").groupBy("given").agg(F.count_distinct("family").alias("usual"))
    cores = full.groupBy("kind", "form").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.first("family").alias("family"), F.first("given").alias("given"), F.max(F.when(F.col("kind") == "org", F.col("short")).otherwise(F.concat("family", F.lit("|"), F.substring("given", 1, 1)))).alias("short"), F.max(F.nullif("middle", F.lit(""))).alias("middle"))
    # Rarity: how many more authors of a family bear the given name by chance, if given names don't depend on families.
    sizes = cores.filter("kind = 'person'").groupBy("family").agg(F.count("*").alias("authors"))
    number = F.broadcast(sizes.agg(F.greatest(F.count("*"), F.lit(1)).alias("number")))  # one row
    cores = cores.join(sizes, "family", "left").crossJoin(number)
    cores = cut(cores.join(families, ["kind", "family"]).join(givens, "given", "left").withColumn("usual", F.when(F.col("kind") != "person", 0).otherwise(F.coalesce("usual", F.lit(0)))).withColumn("chance", F.when(F.col("kind") == "person", (F.col("authors") - 1) * F.col("usual") / F.col("number")).otherwise(0.0)).drop("authors", "number"), "cores")

    # Second surnames: 'family-second|given' is 'family|given' where that occurs.
    second = cores.filter("kind = 'person' AND family LIKE '%_-_%'").withColumn("target", F.concat(F.regexp_replace("family", "^((?:al-|el-)?[^-]+)-.*$", "$1"), F.lit("|"), F.col("given")))
    second = second.join(cores.filter("kind = 'person'").select(F.col("form").alias("target")), "target").filter("target <> form").select("form", "target", F.lit("second surname").alias("rule"))
    second = second.join(second.groupBy("target").agg(F.count("*").alias("ways")), "target").select("form", "target", "rule", "ways")

    # Typing errors: forms with one character left out.
    # Words of institutions are in alphabetical order, which a slip in a first letter changes: so also ordered by their ends.
    by_ends = F.concat("family", F.lit("|"), F.concat_ws(" ", F.array_sort(F.transform(F.split(F.substring_index("form", "|", -1), " "), F.reverse))))
    texts = F.when(F.col("kind") == "org", F.array(F.col("form"), by_ends)).otherwise(F.array("form"))
    columns = ("form", "text", "k", "n", "family", "given", "spellings", "usual")
    slips = cores.select("*", F.explode(texts).alias("text")).select("kind", *columns, F.explode(_shortened(F.col("text"))).alias("slip"))
    a = slips.select("kind", "slip", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = slips.select("kind", "slip", *[F.col(c).alias(f"b_{c}") for c in columns])
    # The rarer spelling is the slip: one spelling only, of a family or a given name that is hardly ever spelt so.
    fewer = F.struct("a_k", "a_n", "a_form") < F.struct("b_k", "b_n", "b_form")
    odd = F.when(F.col("kind") == "org", fewer).when(F.col("a_family") != F.col("b_family"), (F.col("a_spellings") * 3 <= F.col("b_spellings")) | ((F.col("a_spellings") == 1) & ((F.col("b_spellings") > 1) | fewer))).otherwise(F.col("a_usual") < F.col("b_usual"))
    near = a.join(b, ["kind", "slip"]).filter((F.col("a_k") == 1) & (F.col("a_form") != F.col("b_form")) & odd & one_edit(F.col("a_text"), F.col("b_text")))
    best = F.max_by("b_form", F.struct("b_k", "b_n", "b_form"))
    slip = near.groupBy("a_form").agg(best.alias("target"), F.count_distinct("b_form").alias("ways")).select(F.col("a_form").alias("form"), "target", F.lit("typing error").alias("rule"), "ways")

    # Targets of targets: second surnames and slips both lead to more usual forms, so two steps end each chain.
    step = _best(second.unionByName(slip), ["form"], [F.col("rule"), F.col("target")], ["target", "rule", "ways"])
    step = cut(step, "steps")
    to = step.select(F.col("form").alias("target"), F.col("target").alias("further"))
    for _ in range(2):
        step = step.join(to, "target", "left").select("form", F.coalesce("further", "target").alias("target"), "rule", "ways")
    ends = cut(cores.join(step, "form", "left").select("kind", "form", F.coalesce("target", "form").alias("entity"), "rule", F.coalesce("ways", F.lit(1)).alias("ways"), "chance", "short", "middle"), "ends")

    # Initials and abbreviated institutions: the only author whose form shortens to them.
    authors = ends.groupBy("kind", "short").agg(F.count_distinct("entity").alias("authors"), F.min("entity").alias("entity"), F.collect_set("middle").alias("middles"))
    brief = read.filter(F.size("forms") == 0).select("name", "kind", "short", "middle", "initials")
    brief = brief.join(authors, ["kind", "short"], "left")
    fits = (F.col("authors") == 1) & ((F.col("middle") == "") | (F.size("middles") == 0) | F.array_contains("middles", F.col("middle"))) & (F.col("initials") != "")
    by_initial = brief.select(
        "name",
        F.when(fits, F.col("entity")).when(F.col("initials") == "", F.concat("short", F.lit("|only"))).otherwise(F.concat_ws("|", "short", F.when(F.coalesce("authors", F.lit(0)) > 0, F.concat(F.lit("open "), F.col("middle"))).otherwise("initials only"))).alias("entity"),
        F.when(fits, "initials").otherwise("own form").alias("rule"),
        (1 / F.greatest(F.coalesce("authors", F.lit(1)), F.lit(1))).alias("score"),
    )
    # Institutions: the short form joins abbreviated spellings with the full ones.
    org = ends.filter("kind = 'org'").groupBy("short").agg(F.max_by("entity", F.length("entity")).alias("joined"))
    whole = full.select("name", "kind", "form", "i", "meant").join(ends.select("kind", "form", "entity", "rule", "ways", "chance", "short"), ["kind", "form"])
    rule = F.coalesce("rule", F.when(F.col("i") > 0, "nickname").when(F.coalesce("joined", "entity") != F.col("entity"), "abbreviation").otherwise("same form"))
    own = ends.filter("kind = 'org'").select(F.col("form").alias("entity"), F.col("short").alias("end_short")).distinct()
    whole = whole.join(own, "entity", "left").join(org.withColumnRenamed("short", "end_short"), "end_short", "left")
    whole = whole.select("name", F.coalesce("joined", "entity").alias("entity"), rule.alias("rule"), (1 / (F.col("ways") * F.when(F.col("i") > 0, F.greatest("meant", F.lit(1))).otherwise(1) + F.col("chance"))).alias("score"))
    return whole.unionByName(by_initial)


def linked_pairs(links: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of names of one entity."""
    a, b = links.select("entity", F.col("name").alias("name_a")), links.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")
