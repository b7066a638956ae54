"""The registered queries on training-data problems and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.normal import normal, normal_items
from termweave.functions.rows import latest
from termweave.llm import cooccurrence, encoding, frequency, language, leakage, linkage, mapping, mixing, names
from termweave.session import broadcast_if_small, cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables in a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Columns of records, once per record_id."""
    return latest(table(spark, folder, "records").select("record_id", "loaded_at", *columns), ["record_id"], ["loaded_at"])


def _p1_keywords(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    rows = cut(_records(spark, folder, "keywords").select("record_id", normal_items("keywords").alias("keywords")), "keywords")
    return frequency.count_terms(frequency.record_counts(rows, "record_id", "keywords")), rows.count()


def _p1_nodes(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    nodes = latest(table(spark, folder, "map_nodes").select("src_file", "node_id", "built_at", "label", "occurrences"), ["src_file", "node_id"], ["built_at"])
    terms = cut(nodes.select("src_file", normal("label").alias("term"), F.coalesce("occurrences", F.lit(0)).alias("occurrences")).filter("term <> ''"), "nodes")
    # A label may occur on two nodes of a map: the map counts once.
    per_map = terms.groupBy("src_file", "term").agg(F.sum("occurrences").alias("occurrences")).select("term", "occurrences", F.lit(1).cast("long").alias("units"))
    maps = table(spark, folder, "map_nodes").select("src_file").distinct().count()
    return frequency.count_terms(per_map), maps


def p1_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Every keyword and node label in normal form with its occurrences, its records or maps, and its mark."""
    keywords, n = _p1_keywords(spark, folder)
    nodes, maps = _p1_nodes(spark, folder)
    marked = frequency.marks(keywords, 2, F.col("units") * 20 > n).withColumn("kind", F.lit("keywords"))
    return marked.unionByName(frequency.marks(nodes, 4, F.col("units") * 10 >= 9 * maps).withColumn("kind", F.lit("nodes"))).select("kind", "term", "occurrences", "units", "mark")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p1_frequency(spark, folder).filter("mark IS NOT NULL").select("kind", "term", "mark")


def _p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    both = F.concat(F.coalesce("keywords", F.array()), F.coalesce("keywords_plus", F.array()))
    rows = _records(spark, folder, "keywords", "keywords_plus").select("record_id", normal_items(both).alias("items"))
    return cooccurrence.scored_pairs(rows, "record_id", "items", min_count=5, min_share=1 / 5000)


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of terms with enough support, with counts, lift and conviction."""
    return _p3_pairs(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that occur together at least 20 times as often as by chance."""
    p = _p3_pairs(spark, folder)
    kept = p.filter((F.col("n_ab") >= 5) & (F.col("n_ab") * 5000 >= F.col("n")) & cooccurrence.at_least(20))
    return kept.select(F.col("item_a").alias("term_a"), F.col("item_b").alias("term_b"))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged titles and abstracts with the original text where it can be recovered."""
    return encoding.repair_garbled(table(spark, folder, "records").select("record_id", "title", "abstract"), "record_id", ["title", "abstract"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and abstracts that were read in a wrong encoding."""
    return encoding.find_garbled(table(spark, folder, "records").select("record_id", "title", "abstract"), "record_id", ["title", "abstract"]).select("record_id", "field")


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling in records.authors with the author it means, the rewriting that tells, and a score."""
    spelt = table(spark, folder, "records").select("record_id", F.explode("authors").alias("name")).filter("name IS NOT NULL")
    return names.link_names(cut(spelt.groupBy("name").agg(F.count("*").alias("n")), "names"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings that mean the same author."""
    return names.linked_pairs(cut(p5_links(spark, folder), "links"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical entry that each keyword entry means, for entries that are not themselves canonical."""
    entries = cut(_records(spark, folder, "keywords").select("record_id", F.posexplode("keywords").alias("pos", "value")), "entries")
    values = entries.select("value").distinct()
    mapped = cut(mapping.map_values(values.repartition(4 * spark.sparkContext.defaultParallelism, "value"), table(spark, folder, "thesaurus"), order=("added_at", "rule_id")), "mapped")
    found = entries.join(broadcast_if_small(mapped), entries["value"].eqNullSafe(mapped["value"]))
    return found.filter("NOT is_canonical").select("record_id", "pos", F.col("entry").alias("replace_by"))


def p6_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All canonical entries within the distance of each spelling in records.keywords, with the path that was met."""
    values = table(spark, folder, "records").select(F.explode("keywords").alias("value")).distinct()
    return mapping.map_candidates(values.repartition(4 * spark.sparkContext.defaultParallelism, "value"), table(spark, folder, "thesaurus"), order=("added_at", "rule_id"))


def _p7_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, folder, "title", "authors", "pub_year", "doi")
    entries = latest(table(spark, folder, "catalog_entries").select("cat_id", "updated_at", "title", "authors", "pub_year", "doi"), ["cat_id"], ["updated_at"])
    return linkage.prepare(records, "record_id", "title", "authors", "pub_year", "doi"), linkage.prepare(entries, "cat_id", "title", "authors", "pub_year", "doi")


def p7_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Records and catalog entries of the same publication with the posterior as confidence."""
    return linkage.match(*_p7_sides(spark, folder)).select(F.col("left_id").alias("record_id"), F.col("right_id").alias("cat_id"), "confidence")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records and catalog entries that describe the same publication."""
    return p7_matches(spark, folder).select("record_id", "cat_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of a test item in a document, with its place."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leakage.find_passages(docs, table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the test items that they leak."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leakage.find_leaks(docs, table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, without the passages of test items."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return leakage.without_leaks(docs, p8_leaks(spark, folder), "doc_id", "text")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each source that are used, with how often."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, table(spark, folder, "mix_targets"), "doc_id", "text")[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reaches."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, table(spark, folder, "mix_targets"), "doc_id", "text")[1]


#: Tokens of a mixture that is wanted smaller than the documents allow.
WANTED_TOKENS = 20_000


def p9_shares_wanted(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached in a mixture of WANTED_TOKENS tokens in all."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, table(spark, folder, "mix_targets"), "doc_id", "text", total=WANTED_TOKENS)[1]


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every document and of every line of the mixed ones."""
    found = language.languages(table(spark, folder, "documents"), table(spark, folder, "lang_samples"), "doc_id", "text", "lang")
    return found.filter("mixed OR seg = -1")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of mixed documents, and other documents whose label is missing or wrong, with their language."""
    found = p10_languages(spark, folder)
    kept = found.filter("lang IS NOT NULL AND ((mixed AND seg >= 0) OR (NOT mixed AND seg = -1 AND named <> lang))")
    return kept.select("doc_id", "seg", "lang")


QUERIES = {"p1_found": p1_found, "p1_frequency": p1_frequency, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_repaired": p4_repaired, "p5_found": p5_found, "p5_links": p5_links, "p6_found": p6_found, "p6_candidates": p6_candidates,
           "p7_found": p7_found, "p7_matches": p7_matches, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_cleaned": p8_cleaned, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_shares_wanted": p9_shares_wanted, "p10_found": p10_found, "p10_languages": p10_languages}

#: The normal form in DuckDB: NFC and the full-width forms, which together stand for NFKC on the terms of the test tables.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_NORM = "trim(regexp_replace(lower(translate(nfc_normalize({}), '" + _WIDE + "', '" + _NARROW.replace("{", "{{").replace("}", "}}") + r"')), '[\s\p{{Z}}\-_‐-—−]+', ' ', 'g'))"
_ONCE = "(SELECT DISTINCT ON (record_id) * FROM records ORDER BY record_id, loaded_at DESC)"

_P1 = f"""
WITH r AS (SELECT record_id, list_transform(keywords, lambda x: {_NORM.format('x')}) AS ks FROM {_ONCE}),
k AS (SELECT record_id, unnest(ks) AS term FROM r),
kc AS (SELECT term, count(*) AS occurrences, count(DISTINCT record_id) AS units FROM k WHERE term <> '' GROUP BY term),
m AS (SELECT src_file, {_NORM.format('label')} AS term, coalesce(occurrences, 0) AS occurrences
      FROM (SELECT DISTINCT ON (src_file, node_id) * FROM map_nodes ORDER BY src_file, node_id, built_at DESC)),
mc AS (SELECT term, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(DISTINCT src_file) AS units FROM m WHERE term <> '' GROUP BY term),
a AS (SELECT 'keywords' AS kind, term, occurrences, units,
      CASE WHEN occurrences <= 2 THEN 'rare' WHEN units * 20 > (SELECT count(*) FROM r) THEN 'common' END AS mark FROM kc
      UNION ALL
      SELECT 'nodes', term, occurrences, units,
      CASE WHEN occurrences <= 4 THEN 'rare' WHEN units * 10 >= 9 * (SELECT count(DISTINCT src_file) FROM map_nodes) THEN 'common' END FROM mc)
"""
_P3 = f"""
WITH r AS (SELECT record_id, list_distinct(list_filter(list_transform(coalesce(keywords, []) || coalesce(keywords_plus, []), lambda x: {_NORM.format('x')}), lambda x: x <> '')) AS ks FROM {_ONCE}),
t AS (SELECT record_id, unnest(ks) AS term FROM r),
s AS (SELECT term, count(*) AS n FROM t GROUP BY term),
c AS (SELECT count(*) AS n FROM r),
p AS (SELECT x.term AS item_a, y.term AS item_b, count(*) AS n_ab FROM t x JOIN t y ON x.record_id = y.record_id AND x.term < y.term GROUP BY 1, 2),
q AS (SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, c.n AS n FROM p JOIN s a ON a.term = item_a JOIN s b ON b.term = item_b, c WHERE n_ab >= 5 AND 5000 * n_ab >= c.n)
"""
SQL = {
    "p1_frequency": _P1 + "SELECT * FROM a",
    "p1_found": _P1 + "SELECT kind, term, mark FROM a WHERE mark IS NOT NULL",
    "p3_pairs": _P3 + "SELECT *, n_ab * n / (n_a * n_b) AS lift, CASE WHEN n_a > n_ab THEN (1 - n_b / n) / (1 - n_ab / n_a) END AS conviction_ab FROM q",
    "p3_found": _P3 + "SELECT item_a AS term_a, item_b AS term_b FROM q WHERE n_ab * n >= 20 * n_a * n_b",
}
