"""The registered queries of the core and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.functions import text
from termweave.functions.rows import latest
from termweave.operators import graph, network, rules, stats
from termweave.operators.packed import split_fields
from termweave.plans import corpus as corpora
from termweave.plans import pipeline
from termweave.session import cut
from termweave.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables in a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Thresholds of the document corpus: terms in so many documents, as a share of all, become nodes; for pairs of rare terms.
DOCS_SHARE, BASKET_MIN = 20, 2
#: Documents a word of the whole document network needs, as in the staged analysis; it does not grow with the table.
DOCS_MIN = pipeline.Options.min_occurrences

# -- SQL shared by the queries ---------------------------------------------------------------------------------------------

_BASKET = """
d AS (SELECT o_orderkey AS doc_id, CAST(year(o_orderdate) AS INT) AS yr, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cit FROM orders),
t AS (SELECT DISTINCT l_orderkey AS doc_id, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT doc_id FROM d)),
"""
_DOCS = r"""
d AS (SELECT doc_id, pub_year AS yr, NULL::BIGINT AS cit, coalesce(lang, '') AS lang FROM documents),
t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}{4,}'))) AS term FROM documents),
"""
_KEPT = """
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
k AS (SELECT * FROM f WHERE df >= {least}),
n AS (SELECT row_number() OVER (ORDER BY df DESC, term) AS id, term AS label, df AS occurrences FROM k),
p AS (SELECT t.doc_id, n.id FROM t JOIN n ON t.term = n.label),
s AS (SELECT doc_id, count(*) AS size FROM p GROUP BY doc_id),
e AS (SELECT a.id AS src, b.id AS dst, sum({weight}) AS weight FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.id < b.id JOIN s ON s.doc_id = a.doc_id GROUP BY 1, 2),
"""
_ONE = "1.0::DOUBLE"
_SHARE = f"(SELECT count(*) // {DOCS_SHARE} FROM documents)"
_NET_B = _BASKET + _KEPT.format(least=BASKET_MIN, weight=_ONE)
_NET_D = _DOCS + _KEPT.format(least=_SHARE, weight=_ONE)
_NODES = """
tls AS (SELECT id, sum(weight) AS w FROM (SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY id),
av AS (SELECT p.id, coalesce(avg(nullif(d.yr, 0)), 0)::DOUBLE AS y, coalesce(avg(d.cit), 0)::DOUBLE AS c FROM p JOIN d USING (doc_id) GROUP BY p.id),
nodes AS (SELECT n.id, label, occurrences, coalesce(w, 0) AS total_link_strength, coalesce(y, 0) AS avg_year, coalesce(c, 0) AS avg_citations FROM n LEFT JOIN tls USING (id) LEFT JOIN av USING (id)),
"""
# The cluster of a term is the label of most of its documents, of equally many the least.
_CLUSTERS = """
lc AS (SELECT p.id, d.lang, count(*) AS c FROM p JOIN d USING (doc_id) GROUP BY 1, 2),
ln AS (SELECT id, lang FROM lc QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, lang) = 1),
cl AS (SELECT id, dense_rank() OVER (ORDER BY lang) AS cluster FROM ln),
"""


def _basket(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.from_orders(spark, folder)


def _net_b(spark: SparkSession, folder: str, counting: str = "full", measures: bool = False) -> network.Network:
    return network.build(cut(_basket(spark, folder), "basket"), counting, BASKET_MIN, measures=measures)


def _docs_least(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "documents").count() // DOCS_SHARE


def _net_d(spark: SparkSession, folder: str, counting: str = "full", least: int | None = None) -> tuple[network.Network, DataFrame]:
    """The network of the documents' words, and the clusters of its nodes; without least that of the SQL's frequent words."""
    docs = cut(corpora.from_documents(spark, folder), "docs")
    net = network.build(docs, counting, _docs_least(spark, folder) if least is None else least)
    here = docs.select("doc_id", "lang", F.explode("terms").alias("label")).join(net.nodes.select("id", "label"), "label")
    most = here.groupBy("id", "lang").count().groupBy("id").agg(F.min(F.struct((-F.col("count")).alias("neg"), "lang")).alias("b")).select("id", F.col("b.lang").alias("lang"))
    names = most.select("lang").distinct()
    numbers = names.withColumn("cluster", F.row_number().over(Window.orderBy("lang")).cast("bigint"))
    return net, cut(most.join(F.broadcast(numbers), "lang").select("id", "cluster"), "clusters")  # languages: a few dozen rows


# -- packed fields ---------------------------------------------------------------------------------------------------------


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every author and keyword of raw_exports with its position, once per raw_id."""
    raw = latest(table(spark, folder, "raw_exports").select("raw_id", "loaded_at", "authors", "keywords"), ["raw_id"], ["loaded_at"])
    return split_fields(raw, "raw_id", {"authors": True, "keywords": False})


# -- counting and the network ----------------------------------------------------------------------------------------------


@query(f"""WITH {_NET_B} top AS (SELECT * FROM e ORDER BY weight DESC, src, dst LIMIT 10)
SELECT a.label AS label_a, b.label AS label_b, weight, weight / (a.occurrences * b.occurrences) AS association_strength FROM top JOIN n a ON a.id = src JOIN n b ON b.id = dst""")
def top_pairs_association(spark: SparkSession, folder: str) -> DataFrame:
    """The ten strongest pairs of parts ordered together, with their association strength."""
    net = _net_b(spark, folder)
    return network.strongest(net.edges, net.nodes)


@query(f"WITH {_BASKET} x AS (SELECT 1) SELECT term, count(*) AS df FROM t GROUP BY term")
def term_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return network.document_frequency(_basket(spark, folder))


@query(f"WITH {_DOCS} x AS (SELECT 1) SELECT term, count(*) AS df FROM t GROUP BY term")
def word_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return network.document_frequency(corpora.from_documents(spark, folder))


@query(f"WITH {_BASKET} x AS (SELECT 1) SELECT count(DISTINCT term) AS terms, count(*) AS entries FROM t")
def vocabulary_size(spark: SparkSession, folder: str) -> DataFrame:
    return network.vocabulary_size(_basket(spark, folder))


def _edges(spark: SparkSession, folder: str, counting: str) -> DataFrame:
    net = _net_b(spark, folder, counting)
    return network.with_labels(net.edges, net.nodes).select("label_a", "label_b", "weight")


_EDGES_SQL = "SELECT a.label AS label_a, b.label AS label_b, weight FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst"


@query(f"WITH {_NET_B} x AS (SELECT 1) {_EDGES_SQL}")
def cooccurrence_full(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder, "full")


@query(f"WITH {_NET_B} x AS (SELECT 1) {_EDGES_SQL}")
def cooccurrence_binary(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder, "binary")


@query(f"WITH {_BASKET + _KEPT.format(least=BASKET_MIN, weight='1.0::DOUBLE / (size - 1)')} x AS (SELECT 1) SELECT a.label AS label_a, b.label AS label_b, round(weight, 6) AS weight FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst")
def cooccurrence_fractional(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder, "fractional").withColumn("weight", F.round("weight", 6))


@query(f"WITH {_NET_B} {_NODES} x AS (SELECT 1) SELECT id, label, occurrences, total_link_strength, round(avg_year, 6) AS avg_year, round(avg_citations, 6) AS avg_citations FROM nodes")
def node_table(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _net_b(spark, folder, measures=True).nodes
    return nodes.withColumn("avg_year", F.round("avg_year", 6)).withColumn("avg_citations", F.round("avg_citations", 6))


@query(f"WITH {_DOCS} f AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT row_number() OVER (ORDER BY df DESC, term) AS id, term AS label, df AS occurrences FROM f ORDER BY df DESC, term LIMIT 200")
def max_terms_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 most frequent words as nodes."""
    return network.numbered(cut(network.kept_terms(corpora.from_documents(spark, folder), 2, 200), "kept"))


@query(f"WITH {_DOCS} f AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT 60 AS target, CASE WHEN (SELECT count(*) FROM f) <= 60 THEN 1 ELSE (SELECT df FROM f ORDER BY df DESC, term LIMIT 1 OFFSET 59) END AS min_occurrences")
def suggest_threshold(spark: SparkSession, folder: str) -> DataFrame:
    least = network.suggest_min_occurrences(cut(network.document_frequency(corpora.from_documents(spark, folder)), "frequency"))
    return spark.createDataFrame([(60, least)], "target int, min_occurrences bigint")


@query(f"WITH {_NET_B} x AS (SELECT id, other FROM (SELECT src AS id, dst AS other FROM e UNION ALL SELECT dst, src FROM e)) SELECT id, count(*) AS degree, list_sort(list(other)) AS neighbors FROM x GROUP BY id")
def degree_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return network.degree(_net_b(spark, folder).edges)


@query(f"WITH {_NET_B} x AS (SELECT 1) SELECT id, doc_id FROM p")
def node_documents(spark: SparkSession, folder: str) -> DataFrame:
    basket = _basket(spark, folder)
    nodes = network.numbered(cut(network.kept_terms(basket, BASKET_MIN), "kept"))
    return network.node_documents(network.present(basket, cut(nodes, "nodes")))


@query("""SELECT DISTINCT record_id FROM records WHERE
contains(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), array_to_string(coalesce(keywords, []), ' '), array_to_string(coalesce(keywords_plus, []), ' ')), 'heat pump')
OR contains(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), array_to_string(coalesce(keywords, []), ' '), array_to_string(coalesce(keywords_plus, []), ' ')), 'green roof')""")
def domain_filter(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.domain_filter(table(spark, folder, "records"), ["heat pump", "green roof"]).select("record_id").distinct()


@query(f"WITH {_BASKET} c AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id) SELECT count(*) AS documents, count(n) AS with_terms FROM d LEFT JOIN c USING (doc_id)")
def keyword_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.coverage(_basket(spark, folder))


# -- text functions --------------------------------------------------------------------------------------------------------

#: The comparison form in DuckDB: NFC and full-width forms stand for NFKC on the test tables.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")
_FORM = "trim(regexp_replace(translate(nfc_normalize(lower({})), '" + _WIDE + "', '" + _NARROW.replace("{", "{{").replace("}", "}}") + r"'), '[\s\p{{Z}}\-_‐–—]+', ' ', 'g'))"
_SING = "CASE WHEN length({0}) <= 3 THEN {0} WHEN {0} LIKE '%ies' AND length({0}) > 4 THEN {0}[:-4] || 'y' WHEN regexp_matches({0}, '(sses|shes|ches|xes|zes)$') THEN {0}[:-3] WHEN {0} LIKE '%s' AND NOT regexp_matches({0}, '(ss|us|is)$') THEN {0}[:-2] ELSE {0} END"
_RECORDS = "(SELECT DISTINCT ON (record_id) * FROM records ORDER BY record_id, loaded_at DESC)"
_TERMS = "SELECT DISTINCT unnest(keywords) AS term FROM records"


def _equal_sql(term: str) -> str:
    """The equivalence rules as nested replacements; word boundaries in DuckDB know ASCII letters only."""
    out = term
    for pattern, replacement in text.EQUIVALENTS:
        out = f"regexp_replace({out}, '(?i){pattern}', '{replacement}', 'g')"
    out = f"trim(regexp_replace({out}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
    return f"CASE WHEN {out} = '' THEN {term} ELSE {out} END"


def _key_sql(normal: str) -> str:
    """The comparison key of a term in comparison form."""
    words = f"list_filter(string_split_regex(regexp_replace({normal}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: {_SING.format('w')}), ' ')"


_EDGE_SQL = text.EDGES.replace("'", "''")
_CLEAN = f"""
c0 AS (SELECT term, trim(translate(regexp_replace(coalesce(term, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '{text.DASHES}', '{'-' * len(text.DASHES)}'), '{_EDGE_SQL}') AS t FROM k),
c1 AS (SELECT term, t, regexp_replace(t[2:-2], '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS i FROM c0),
c2 AS (SELECT term, CASE WHEN length(t) > 2 AND t LIKE '(%)' AND length(replace(i, '(', '')) = length(replace(i, ')', '')) THEN i ELSE t END AS t FROM c1),
c3 AS (SELECT term, t, regexp_replace(regexp_replace(t, '[\\s\\p{{Z}}]*\\([^)]*$', ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS h, list_transform(range(1, length(t) + 1), lambda n: (length(t[:n]) - length(replace(t[:n], '(', ''))) - (length(t[:n]) - length(replace(t[:n], ')', '')))) AS d FROM c2),
c4 AS (SELECT term, t, h, length(replace(t, '(', '')) = length(replace(t, ')', '')) AS even, h <> '' AND length(replace(h, '(', '')) = length(replace(h, ')', '')) AS cut,
       array_to_string(list_transform(list_filter(range(1, length(t) + 1), lambda n: NOT (t[n] = ')' AND d[n] < least(0, coalesce(list_min(d[1:n - 1]), 0)))), lambda n: t[n]), '') AS u FROM c3),
c5 AS (SELECT *, list_transform(range(1, length(u) + 1), lambda n: (length(u[n:]) - length(replace(u[n:], '(', ''))) - (length(u[n:]) - length(replace(u[n:], ')', '')))) AS e, length(replace(u, ')', '')) - length(replace(u, '(', '')) AS open FROM c4),
c6 AS (SELECT *, array_to_string(list_transform(list_filter(range(1, length(u) + 1), lambda n: NOT (u[n] = '(' AND length(u[n:]) - length(replace(u[n:], '(', '')) <= open)), lambda n: u[n]), '') AS v FROM c5),
"""


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records").select(F.explode("keywords").alias("term")).distinct()


@query(f"WITH k AS ({_TERMS}), {_CLEAN} x AS (SELECT 1) SELECT term, trim(regexp_replace(trim(CASE WHEN even THEN t WHEN cut THEN h ELSE v END, '{_EDGE_SQL}'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS cleaned FROM c6")
def clean_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned forms of every keyword."""
    return _keywords(spark, folder).select("term", text.clean_term(F.col("term")).alias("cleaned"))


@query(r"SELECT raw_id, list_filter(list_transform(regexp_split_to_array(coalesce(authors, ''), '[;；]'), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS parts FROM (SELECT DISTINCT raw_id, authors FROM raw_exports)")
def split_multi(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_exports").select("raw_id", "authors").distinct()
    return rows.select("raw_id", text.split_multi(F.col("authors")).alias("parts"))


@query(r"SELECT DISTINCT pub_year, regexp_extract(coalesce(pub_year, ''), '(?:^|[^\p{L}\p{N}_])((?:19|20)\d{2})(?:$|[^\p{L}\p{N}_])', 1) AS year FROM records")
def year_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records").select("pub_year").distinct().select("pub_year", text.year(F.col("pub_year")).alias("year"))


@query(r"SELECT DISTINCT pub_year, TRY_CAST(nullif(regexp_replace(pub_year, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits FROM records")
def citation_digits(spark: SparkSession, folder: str) -> DataFrame:
    """All digits of a text as a number, here of years as written."""
    return table(spark, folder, "records").select("pub_year").distinct().select("pub_year", text.citations(F.col("pub_year")).alias("digits"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, CASE WHEN length(word) <= 3 THEN word WHEN word LIKE '%ies' AND length(word) > 4 THEN word[:-4] || 'y'
WHEN regexp_matches(word, '(sses|shes|ches|xes|zes)$') THEN word[:-3] WHEN word LIKE '%s' AND NOT regexp_matches(word, '(ss|us|is)$') THEN word[:-2] ELSE word END AS singular FROM w""")
def singularize(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return words.select("word", text.singularize(F.col("word")).alias("singular"))


@query(f"WITH k AS ({_TERMS}), q AS (SELECT term, {_equal_sql('term')} AS t FROM k), f AS (SELECT term, {_FORM.format('t')} AS n FROM q) SELECT term, {_key_sql('n')} AS key FROM f")
def key_form(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison keys of every keyword, after the equivalence rules."""
    return _keywords(spark, folder).select("term", text.key_form(text.equivalents(F.col("term"))).alias("key"))


_PHRASE = "p_type || ' ' || p_name || ' for the elderly, IoT and telemonitoring'"


@query(f"WITH k AS (SELECT DISTINCT {_PHRASE} AS term FROM part) SELECT term, {_equal_sql('term')} AS replaced FROM k")
def builtin_rules(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "part").select(F.concat_ws(" ", "p_type", "p_name", F.lit("for the elderly, IoT and telemonitoring")).alias("term")).distinct()
    return terms.select("term", text.equivalents(F.col("term")).alias("replaced"))


# -- rules -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH k AS (SELECT record_id, unnest(list_distinct(keywords)) AS term FROM {_RECORDS}), c AS (SELECT term, count(*) AS df FROM k WHERE term <> '' GROUP BY term),
q AS (SELECT term, df, {_equal_sql('term')} AS t FROM c), f AS (SELECT term, df, {_FORM.format('t')} AS n FROM q), g AS (SELECT term, df, {_key_sql('n')} AS key FROM f),
b AS (SELECT key, term AS canonical, df AS canonical_df FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY df DESC, term) = 1)
SELECT canonical, term AS member, canonical_df, df AS member_df FROM g JOIN b USING (key) WHERE term <> canonical""")
def auto_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords with one comparison key, under the most frequent of them."""
    return rules.auto_groups(cut(network.document_frequency(corpora.from_records(spark, folder)), "frequency"))


def _top_pairs(corpus: DataFrame, frequency: DataFrame) -> DataFrame:
    top = cut(network.top_terms(frequency, rules.TOP), "top")
    nodes = cut(network.numbered(top), "nodes")
    named = network.with_labels(network.edges_of(network.present(corpus, nodes)), nodes)
    return named.select(F.least("label_a", "label_b").alias("term_a"), F.greatest("label_a", "label_b").alias("term_b"), F.col("weight").cast("bigint").alias("n_ab"))


def _candidates(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    docs = cut(corpora.from_documents(spark, folder), "docs")
    frequency = cut(network.document_frequency(docs), "frequency")
    return rules.fuzzy_candidates(frequency, _top_pairs(docs, frequency), kinds=(kind,))


@query(f"""WITH {_DOCS} f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
r AS (SELECT term, df, row_number() OVER (ORDER BY df DESC, term) AS rk, {_SING.format('term')} AS key FROM f ORDER BY df DESC, term LIMIT 300),
x AS (SELECT t.doc_id, term FROM t JOIN r USING (term)),
pc AS (SELECT a.term AS ta, b.term AS tb, count(*) AS n FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2),
c AS (SELECT a.term AS a, b.term AS b, a.df AS da, b.df AS db, a.rk AS ra, b.rk AS rb FROM r a JOIN r b ON a.rk < b.rk AND a.key <> b.key AND length(a.key) >= 3 AND length(b.key) >= 3 AND (contains(a.key, b.key) OR contains(b.key, a.key))),
m AS (SELECT CASE WHEN da > db OR (da = db AND length(a) <= length(b)) THEN a ELSE b END AS canonical, CASE WHEN da > db OR (da = db AND length(a) <= length(b)) THEN b ELSE a END AS member,
      round(coalesce(n, 0) / least(da, db), 3) AS rate, ra, rb FROM c LEFT JOIN pc ON ta = least(a, b) AND tb = greatest(a, b))
SELECT canonical, member, 'containment' AS kind, 0.0::DOUBLE AS similarity, rate FROM m QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY rate, ra, rb) = 1""")
def fuzzy_containment(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder, "containment")


@query()
def fuzzy_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder, "similarity")


def _thesaurus(spark: SparkSession, folder: str) -> DataFrame:
    return rules.ordered_rules(table(spark, folder, "thesaurus").select("label", "replace_by", F.col("rule_id").alias("seq")))


def _chains(source: str, name: str) -> str:
    """The ends of the chains of a table (label, target); a cycle ends in its least member."""
    return f"""
{name}_walk AS (SELECT label, target AS nxt, [label] AS path, 0 AS depth FROM {source}
         UNION ALL SELECT k.label, w.target, list_append(path, w.label), depth + 1 FROM {name}_walk k JOIN {source} w ON w.label = k.nxt WHERE NOT list_contains(path, w.label)),
{name}_ends AS (SELECT label, arg_max(nxt, depth) AS nxt, arg_max(path, depth) AS path FROM {name}_walk GROUP BY label),
{name} AS (SELECT label, CASE WHEN list_contains(path, nxt) THEN list_min(path[list_position(path, nxt):]) ELSE nxt END AS target FROM {name}_ends),
"""


_RULES = f"""
r AS (SELECT trim(label) AS label, trim(coalesce(replace_by, '')) AS target, rule_id FROM thesaurus WHERE trim(label) <> ''),
w AS (SELECT label, arg_max(target, rule_id) AS target FROM r WHERE target <> '' GROUP BY label),
{_chains('w', 'res')}
"""
_MERGE = f"""
m1 AS (SELECT label, target FROM res WHERE label <> target),
mf AS (SELECT {_FORM.format('label')} AS label, arg_max(target, label) AS target FROM m1 GROUP BY 1),
m2 AS (SELECT * FROM m1 UNION ALL SELECT * FROM mf WHERE label NOT IN (SELECT label FROM m1)),
{_chains('m2', 'm3')}
m AS (SELECT * FROM m3 WHERE label <> target),
de AS (SELECT DISTINCT {_FORM.format('label')} AS form FROM r WHERE target = ''),
ke AS (SELECT record_id AS doc_id, unnest(keywords) AS raw, generate_subscripts(keywords, 1) AS pos FROM {_RECORDS}),
kn AS (SELECT doc_id, pos, trim(raw) AS term, {_FORM.format('trim(raw)')} AS form FROM ke WHERE trim(raw) <> ''),
kt AS (SELECT kn.*, coalesce(a.target, b.target, term) AS target FROM kn LEFT JOIN m a ON a.label = term LEFT JOIN m b ON b.label = kn.form),
ks AS (SELECT *, CASE WHEN form IN (SELECT form FROM de) OR (target <> term AND {_FORM.format('target')} IN (SELECT form FROM de)) THEN 'dropped' WHEN target <> term THEN 'merged' ELSE 'kept' END AS status FROM kt),
"""


@query(f"WITH RECURSIVE {_RULES} x AS (SELECT 1) SELECT label, target FROM res WHERE label <> target")
def resolve_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Each label of the thesaurus with the end of its chain of rules."""
    return rules.resolve(rules.winning(_thesaurus(spark, folder)))


def _merged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = corpora.from_records(spark, folder).select("doc_id", "terms")
    given = cut(_thesaurus(spark, folder), "rules")
    return rules.merge_terms(docs, cut(rules.full_mapping(None, given), "mapping"), rules.drop_terms(given))


@query(f"""WITH RECURSIVE {_RULES} {_MERGE} kd AS (SELECT doc_id, target, min(pos) AS pos FROM ks WHERE status <> 'dropped' GROUP BY 1, 2), kl AS (SELECT doc_id, list(target ORDER BY pos) AS terms FROM kd GROUP BY 1)
SELECT record_id AS doc_id, coalesce(terms, []) AS terms FROM {_RECORDS} LEFT JOIN kl ON doc_id = record_id""")
def merge_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of each record after the thesaurus."""
    return _merged(spark, folder)[0]


@query(f"WITH RECURSIVE {_RULES} {_MERGE} x AS (SELECT 1) SELECT count(*) FILTER (status = 'merged') AS merged, count(*) FILTER (status = 'dropped') AS dropped, count(*) FILTER (status = 'kept') AS kept FROM ks")
def merge_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rules.merge_stats(_merged(spark, folder)[1])


_EXTRA = ("field observation", "participatory design", "results", "overview")
_GENERIC = ", ".join("('" + t.replace("'", "''") + "')" for t in (*text.GENERIC_EN, *text.GENERIC_ZH, *_EXTRA))


@query(f"""WITH g AS (SELECT {_FORM.format('t')} AS form FROM (VALUES {_GENERIC}) v(t)), k AS (SELECT record_id, unnest(list_distinct(keywords)) AS term FROM {_RECORDS}),
c AS (SELECT term, count(*) AS df FROM k WHERE term <> '' GROUP BY term) SELECT term, df FROM c WHERE {_FORM.format('term')} NOT IN (SELECT form FROM g)""")
def drop_generic(spark: SparkSession, folder: str) -> DataFrame:
    """Which keywords the list of generic terms, with a few of this field, leaves."""
    frequency = network.document_frequency(corpora.from_records(spark, folder))
    return rules.drop_generic(frequency, list(_EXTRA))[0]


# -- statistics and graphs -------------------------------------------------------------------------------------------------

_LF = "lgamma({}::DOUBLE + 1)"


def _choose(n: str, k: str) -> str:
    return f"({_LF.format(n)} - {_LF.format(k)} - {_LF.format(f'({n} - {k})')})"


_TAIL = f"""CASE WHEN seen >= least(oa, ob) THEN 1.0 WHEN seen < greatest(0, oa + ob - nn) THEN 0.0 ELSE
least(1.0, list_sum(list_transform(range(greatest(0, oa + ob - nn), seen + 1), lambda x: exp({_choose('oa', 'x')} + {_choose('(nn - oa)', '(ob - x)')} - {_choose('nn', 'ob')})))) END"""
_GAPS = f"""
nd AS (SELECT count(*) AS nn FROM d),
q AS (SELECT a.id AS ia, b.id AS ib, a.label AS ta, b.label AS tb, ca.cluster AS cla, cb.cluster AS clb, a.occurrences AS oa, b.occurrences AS ob, nn
      FROM n a JOIN n b ON a.id < b.id JOIN cl ca ON ca.id = a.id JOIN cl cb ON cb.id = b.id, nd WHERE ca.cluster <> cb.cluster AND a.occurrences * b.occurrences >= nn),
g AS (SELECT q.*, coalesce(weight, 0)::DOUBLE AS actual, oa * ob / nn::DOUBLE AS expected, CAST(coalesce(weight, 0) AS BIGINT) AS seen FROM q LEFT JOIN e ON src = ia AND dst = ib),
h AS (SELECT *, actual / expected AS ratio, {_TAIL} AS p_value FROM g WHERE actual / expected < 0.35),
"""
_D_ALL = f"WITH {_NET_D} {_CLUSTERS}"


@query(f"{_D_ALL} {_GAPS} x AS (SELECT 1) SELECT ta AS term_a, tb AS term_b, cla AS cluster_a, clb AS cluster_b, oa AS occ_a, ob AS occ_b, actual, round(expected, 6) AS expected, round(ratio, 6) AS ratio, round(p_value, 6) AS p_value, p_value < 0.05 AS significant FROM h")
def gaps(spark: SparkSession, folder: str, least: int | None = None) -> DataFrame:
    """Words of different languages' texts found together less than by chance: every pair tested."""
    net, clusters = _net_d(spark, folder, least=least)
    pairs = stats.gap_pairs(net.nodes, net.edges, clusters, net.n_docs)
    return pairs.select("term_a", "term_b", "cluster_a", "cluster_b", "occ_a", "occ_b", "actual", *[F.round(c, 6).alias(c) for c in ("expected", "ratio", "p_value")], "significant")


@query(f"{_D_ALL} {_GAPS} x AS (SELECT 1) SELECT count(*) AS n_tested, count(*) FILTER (p_value < 0.05) AS n_significant FROM h")
def gap_summary(spark: SparkSession, folder: str, least: int | None = None) -> DataFrame:
    net, clusters = _net_d(spark, folder, least=least)
    return stats.gap_summary(stats.gap_pairs(net.nodes, net.edges, clusters, net.n_docs))


_Q = """
m AS (SELECT sum(weight) AS m FROM e),
ins AS (SELECT a.cluster, sum(weight) AS w FROM e JOIN cl a ON a.id = src JOIN cl b ON b.id = dst WHERE a.cluster = b.cluster GROUP BY 1),
deg AS (SELECT cluster, sum(weight) AS dw FROM (SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e) JOIN cl USING (id) GROUP BY 1),
mq AS (SELECT sum(coalesce(w, 0) / m - (dw / (2 * m)) * (dw / (2 * m))) AS q FROM deg LEFT JOIN ins USING (cluster), m),
"""


@query(f"{_D_ALL} {_Q} x AS (SELECT 1) SELECT round(q, 9) AS q FROM mq")
def modularity(spark: SparkSession, folder: str, least: int | None = None) -> DataFrame:
    net, clusters = _net_d(spark, folder, least=least)
    return stats.modularity(net.edges, clusters).select(F.round("q", 9).alias("q"))


@query(f"""{_D_ALL} {_NODES} r AS (SELECT cluster, nodes.*, row_number() OVER (PARTITION BY cluster ORDER BY total_link_strength DESC, id) AS rk FROM nodes JOIN cl USING (id))
SELECT cluster, count(*) AS size, list(label ORDER BY rk) FILTER (rk <= 8) AS top_terms, CAST(sum(occurrences) AS BIGINT) AS total_occurrences, round(avg(avg_year) FILTER (avg_year > 0), 6) AS avg_year, round(avg(avg_citations) FILTER (avg_citations > 0), 6) AS avg_citations FROM r GROUP BY cluster""")
def cluster_profile(spark: SparkSession, folder: str, least: int | None = None) -> DataFrame:
    net, clusters = _net_d(spark, folder, least=least)
    return stats.cluster_profile(net.nodes, clusters).withColumn("avg_year", F.round("avg_year", 6)).withColumn("avg_citations", F.round("avg_citations", 6))


@query(f"""{_D_ALL} {_Q} x AS (SELECT 1) SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(DISTINCT cluster) FROM cl) AS n_clusters,
(SELECT round(q, 9) FROM mq) AS q, (SELECT CASE WHEN q >= 0.5 THEN 'clear' WHEN q >= 0.3 THEN 'acceptable' WHEN q > 0 THEN 'weak' ELSE 'none' END FROM mq) AS verdict,
(SELECT round(avg(weight / (a.occurrences * b.occurrences)), 9) FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst) AS mean_association""")
def network_metrics(spark: SparkSession, folder: str, least: int | None = None) -> DataFrame:
    net, clusters = _net_d(spark, folder, least=least)
    return stats.network_summary(net.nodes, net.edges, clusters, net.n_docs).withColumn("q", F.round("q", 9)).withColumn("mean_association", F.round("mean_association", 9))


# The queries above keep the share of documents that their SQL has; these run over every word of DOCS_MIN documents.
for _whole in (gaps, gap_summary, modularity, cluster_profile, network_metrics):
    query(name=f"{_whole.__name__}_whole")(lambda spark, folder, _whole=_whole: _whole(spark, folder, DOCS_MIN))


def _strong(net: network.Network) -> DataFrame:
    """Edges of at least 1.15 times the mean weight, so that components differ."""
    mean = net.edges.agg((F.avg("weight") * 1.15).alias("least"))
    return net.edges.join(F.broadcast(mean), F.col("weight") >= F.col("least")).select("src", "dst", "weight")  # one row


_STRONG = "st AS (SELECT * FROM e WHERE weight >= (SELECT avg(weight) * 1.15 FROM e)), sy AS (SELECT src AS id, dst AS other FROM st UNION ALL SELECT dst, src FROM st),"
_REACH = "rc AS (SELECT id, id AS other FROM n UNION SELECT rc.id, sy.other FROM rc JOIN sy ON rc.other = sy.id), comp AS (SELECT id, min(other) AS component FROM rc GROUP BY id),"


@query(f"WITH RECURSIVE {_NET_B} {_STRONG} {_REACH} x AS (SELECT 1) SELECT id, component FROM comp")
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    net = _net_b(spark, folder)
    return graph.connected_components(net.nodes, _strong(net))


@query(f"WITH RECURSIVE {_NET_B} {_STRONG} {_REACH} big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT n.id, label FROM n JOIN comp USING (id) JOIN big USING (component)")
def largest_component(spark: SparkSession, folder: str) -> DataFrame:
    net = _net_b(spark, folder)
    return graph.largest_component(net.nodes, cut(_strong(net), "strong"))[0].select("id", "label")


@query()
def louvain(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the words' network."""
    net, _ = _net_d(spark, folder, least=DOCS_MIN)
    return graph.louvain(net.nodes, net.edges)


@query()
def betweenness_top10(spark: SparkSession, folder: str) -> DataFrame:
    net = _net_b(spark, folder)
    top = graph.betweenness(net.nodes, net.edges).orderBy(F.desc("betweenness"), "id").limit(10)
    return top.join(net.nodes.select("id", "label"), "id").select("id", "label", "betweenness")


# -- sinks -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {_NET_B} {_NODES} x AS (SELECT 1) SELECT id, id || chr(9) || label || chr(9) || chr(9) || occurrences || chr(9) || printf('%.0f', total_link_strength) || chr(9) || CASE WHEN avg_year <> 0 THEN printf('%.1f', avg_year) ELSE '' END || chr(9) || CASE WHEN avg_citations <> 0 THEN printf('%.2f', avg_citations) ELSE '' END AS line FROM nodes")
def map_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.map_rows(_net_b(spark, folder, measures=True).nodes)


@query(f"WITH {_NET_B} x AS (SELECT 1) SELECT src, dst, src || chr(9) || dst || chr(9) || printf('%.0f', weight) AS line FROM e")
def network_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.network_rows(_net_b(spark, folder).edges)


@query(f"WITH {_NET_B} b AS (SELECT src AS id, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e), g AS (SELECT a.id, c.id AS other, coalesce(weight, 0) AS w FROM n a CROSS JOIN n c LEFT JOIN b ON b.id = a.id AND b.other = c.id) SELECT id, id || chr(9) || string_agg(printf('%.0f', w), chr(9) ORDER BY other) AS line FROM g GROUP BY id")
def network_dense(spark: SparkSession, folder: str) -> DataFrame:
    net = _net_b(spark, folder)
    return sinks.dense_rows(net.nodes, net.edges)


@query(f"WITH RECURSIVE {_RULES} x AS (SELECT 1) SELECT 0 AS part, label, label || chr(9) || target AS line FROM res WHERE label <> target UNION ALL SELECT DISTINCT 1, label, label || chr(9) FROM r WHERE target = ''")
def thesaurus_rows(spark: SparkSession, folder: str) -> DataFrame:
    given = cut(_thesaurus(spark, folder), "rules")
    return sinks.thesaurus_rows(rules.resolve(rules.winning(given)), rules.drop_terms(given))


# -- sources ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_NET_B} x AS (SELECT 1) SELECT src, dst, weight FROM e")
def network_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Edges written as lines, in either order of ends, and read again."""
    lines = sinks.network_rows(_net_b(spark, folder).edges)
    turned = F.when(F.col("src") % 2 == 0, F.regexp_replace("line", r"^(\d+)\t(\d+)", "$2\t$1")).otherwise(F.col("line"))
    return readers.network_of_lines(lines.select(turned.alias("value")))


@query("SELECT doc_id, text FROM documents")
def inverted_abstracts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts rebuilt from their inverted indexes."""
    words = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("doc_id", text.text_from_positions(F.col("index")).alias("text"))


#: Characters that no format gives a meaning: what else titles, names and terms hold becomes a space before they are written.
_PLAIN = {"title": r"[^\p{L}\p{N} ,.:-]+", "name": r"[^\p{L}\p{N} ,.-]+", "term": r"[^\p{L}\p{N} -]+", "doi": r"[^A-Za-z0-9./-]+"}


def _plain(col, kind: str):
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), _PLAIN[kind], "" if kind == "doi" else " "), " +", " "))


def _plain_sql(col: str, kind: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({col}, ''), '{_PLAIN[kind]}', '{'' if kind == 'doi' else ' '}', 'g'), ' +', ' ', 'g'))"


def _tags(tag: str, col):
    """A line per value of an array, each after its tag."""
    return F.concat_ws("", F.transform(col, lambda x: F.concat(F.lit(tag), x, F.lit("\n"))))


def _quoted(*cells):
    return F.concat(F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) for c in cells]), F.lit("\n"))


def _exports() -> dict:
    """Per format: what stands before, between and after the records of a file, and a record as text."""
    t, s, y, d, c = (F.col(x) for x in ("title", "source", "pub_year", "doi", "citations"))
    a, k, n = F.col("authors"), F.col("keywords"), F.coalesce(F.col("citations").cast("string"), F.lit(""))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shown = lambda x: F.struct(x.alias("display_name"))
    work = F.struct(
        t.alias("title"), y.alias("publication_year"), F.transform(a, lambda x: F.struct(shown(x).alias("author"))).alias("authorships"), F.transform(k, shown).alias("keywords"),
        F.struct(shown(s).alias("source")).alias("primary_location"), F.concat(F.lit("https://doi.org/"), d).alias("doi"), c.alias("cited_by_count"),
    )
    article = line(
        "<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>", y, "</MedlineDate></PubDate></JournalIssue><Title>", s, "</Title></Journal><ArticleTitle>", t, "</ArticleTitle><AuthorList>",
        F.concat_ws("", F.transform(a, lambda x: line("<Author><CollectiveName>", x, "</CollectiveName></Author>"))), "</AuthorList></Article><KeywordList>", F.concat_ws("", F.transform(k, lambda x: line("<Keyword>", x, "</Keyword>"))),
        '</KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">', d, "</ArticleId></ArticleIdList></PubmedData></PubmedArticle>",
    )
    joined = lambda x: F.concat_ws("; ", x)
    return {
        "wos": ("", "", "", line("PT J\nAU ", joined(a), "\nTI ", t, "\nSO ", s, "\nDE ", joined(k), "\nPY ", y, "\nTC ", n, "\nDI ", d, "\nER\n\n")),
        "ris": ("", "", "", line("TY  - JOUR\n", _tags("AU  - ", a), "TI  - ", t, "\nJO  - ", s, "\nPY  - ", y, "\nDO  - ", d, "\n", _tags("KW  - ", k), "ER  - \n\n")),
        "refworks": ("", "", "", line("RT Journal\n", _tags("A1 ", a), "T1 ", t, "\nJF ", s, "\nYR ", y, "\nK1 ", joined(k), "\n\n")),
        "endnote": ("", "", "", line("%0 Journal Article\n", _tags("%A ", a), "%T ", t, "\n%J ", s, "\n%D ", y, "\n%K ", joined(k), "\n\n")),
        "bibtex": ("", "", "", line("@article{x,\n author = {", F.concat_ws(" and ", a), "},\n title = {", t, "},\n journal = {", s, "},\n year = {", y, "},\n doi = {", d, "},\n keywords = {", F.concat_ws(", ", k), "}\n}\n\n")),
        "scopus": ("Authors,Title,Year,Source title,Cited by,DOI,Author Keywords,EID\n", "", "", _quoted(joined(a), t, y, s, n, d, joined(k))),
        "table": ("Title,Author,Year,Source,Keywords,DOI\n", "", "", _quoted(t, joined(a), y, s, joined(k), d)),
        "works_json": ("[", ",", "]", F.to_json(work)),
        "articles_xml": ("<PubmedArticleSet>", "", "</PubmedArticleSet>", article),
    }


#: Columns that not every format has.
_WITH_DOI, _WITH_CITATIONS = ("wos", "ris", "bibtex", "scopus", "table", "works_json", "articles_xml"), ("wos", "scopus", "works_json")
_YEAR_SQL = r"regexp_extract(coalesce(pub_year, ''), '(?:^|[^\p{L}\p{N}_])((?:19|20)\d{2})(?:$|[^\p{L}\p{N}_])', 1)"


def _read_sql(name: str) -> str:
    authors = f"list_filter(list_transform(coalesce(authors, []), lambda x: regexp_replace({_plain_sql('x', 'name')}, '(?i) and ', ' + ', 'g')), lambda x: x <> '')"
    keywords = f"list_filter(list_transform(coalesce(keywords, []), lambda x: {_plain_sql('x', 'term')}), lambda x: x <> '')"
    more = f", {_plain_sql('doi', 'doi')} AS doi" * (name in _WITH_DOI) + (", coalesce(citations, 0) AS citations" if name == "works_json" else ", citations" * (name in _WITH_CITATIONS))
    return f"SELECT src_file, row_number() OVER (PARTITION BY src_file ORDER BY record_id) - 1 AS ordinal, {_plain_sql('title', 'title')} AS title, {_YEAR_SQL} AS pub_year, {_plain_sql('source', 'title')} AS source, {authors} AS authors, {keywords} AS keywords{more} FROM {_RECORDS}"


def _read_again(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The records, with their own authors and keywords, written as one export per file, and read again."""
    rows = latest(table(spark, folder, "records").select("record_id", "loaded_at", "src_file", "title", "pub_year", "source", "doi", "authors", "keywords", "citations"), ["record_id"], ["loaded_at"])
    none = F.array().cast("array<string>")
    listed = lambda c, kind: F.filter(F.transform(F.coalesce(c, none), lambda x: F.regexp_replace(_plain(x, kind), "(?i) and ", " + ") if kind == "name" else _plain(x, kind)), lambda x: x != "")
    rows = rows.select("record_id", "src_file", _plain(F.col("title"), "title").alias("title"), text.year(F.col("pub_year")).alias("pub_year"), _plain(F.col("source"), "title").alias("source"), _plain(F.col("doi"), "doi").alias("doi"), listed("authors", "name").alias("authors"), listed("keywords", "term").alias("keywords"), "citations")
    before, between, after, entry = _exports()[name]
    files = rows.select("src_file", "record_id", entry.alias("entry")).groupBy("src_file").agg(F.array_sort(F.collect_list(F.struct("record_id", "entry"))).alias("entries"))
    texts = files.select("src_file", F.concat(F.lit(before), F.concat_ws(between, F.transform("entries", lambda x: x["entry"])), F.lit(after)).alias("text"))
    columns = ["title", "pub_year", "source", "authors", "keywords"] + ["doi"] * (name in _WITH_DOI) + ["citations"] * (name in _WITH_CITATIONS)
    return readers.parse_texts(texts, "src_file", "text", name).select("src_file", "ordinal", *columns)


for _name in ("wos", "ris", "refworks", "endnote", "bibtex", "scopus", "table", "works_json", "articles_xml"):
    query(_read_sql(_name), f"{_name}_reader")(lambda spark, folder, _name=_name: _read_again(spark, folder, _name))


# -- the keyword network of the records ------------------------------------------------------------------------------------

_KEYWORDS = f"""
d AS (SELECT record_id AS doc_id, TRY_CAST({_YEAR_SQL} AS INT) AS yr, citations AS cit FROM {_RECORDS}),
t AS (SELECT * FROM (SELECT record_id AS doc_id, unnest(list_distinct(keywords)) AS term FROM {_RECORDS}) WHERE term <> ''),
"""
_NET_K = _KEYWORDS + _KEPT.format(least=DOCS_MIN, weight=_ONE)
_NET_K2 = _KEYWORDS + _KEPT.format(least=BASKET_MIN, weight=_ONE)


def _net_k(spark: SparkSession, folder: str, least: int = DOCS_MIN, measures: bool = False) -> network.Network:
    return network.build(cut(corpora.from_records(spark, folder), "records"), min_occurrences=least, measures=measures)


@query(f"WITH {_NET_K} {_NODES} x AS (SELECT 1) SELECT id, label, occurrences, total_link_strength, round(avg_year, 6) AS avg_year, round(avg_citations, 6) AS avg_citations FROM nodes")
def keyword_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the network of the records' keywords."""
    return _net_k(spark, folder, measures=True).nodes.withColumn("avg_year", F.round("avg_year", 6)).withColumn("avg_citations", F.round("avg_citations", 6))


@query(f"WITH {_NET_K} x AS (SELECT 1) {_EDGES_SQL}")
def keyword_edges(spark: SparkSession, folder: str) -> DataFrame:
    net = _net_k(spark, folder)
    return network.with_labels(net.edges, net.nodes).select("label_a", "label_b", "weight")


_K_REACH = "sy AS (SELECT src AS id, dst AS other FROM e UNION ALL SELECT dst, src FROM e), rc AS (SELECT id, id AS other FROM n UNION SELECT rc.id, sy.other FROM rc JOIN sy ON rc.other = sy.id), comp AS (SELECT id, min(other) AS component FROM rc GROUP BY id),"


@query(f"WITH RECURSIVE {_NET_K2} {_K_REACH} x AS (SELECT 1) SELECT id, dense_rank() OVER (ORDER BY component) AS cluster FROM comp")
def keyword_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the network of all keywords that two records have, over all its edges, numbered by their least node."""
    net = _net_k(spark, folder, BASKET_MIN)
    return graph.numbered_components(cut(graph.connected_components(net.nodes, net.edges), "components"))


@query(f"WITH {_KEYWORDS} x AS (SELECT 1) SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(DISTINCT doc_id) FROM t) AS with_terms, (SELECT count(DISTINCT doc_id) FROM t) / (SELECT count(*) FROM d) AS share, (SELECT min(yr) FROM d) AS first_year, (SELECT max(yr) FROM d) AS last_year")
def year_range(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.year_range(corpora.from_records(spark, folder))


@query()
def keyword_louvain(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the network of the records' keywords."""
    net = _net_k(spark, folder)
    return graph.louvain(net.nodes, net.edges)


@query(f"{_D_ALL} {_GAPS} x AS (SELECT 1) SELECT ta AS term_a, tb AS term_b, round(ratio, 6) AS ratio, round(p_value, 4) AS p_value FROM h ORDER BY p_value < 0.05 DESC, round_even(p_value, 4), ia, ib LIMIT 15")
def gaps_top15(spark: SparkSession, folder: str) -> DataFrame:
    """The first gaps of the report: significant ones first, then by p, equal ones by their nodes."""
    net, clusters = _net_d(spark, folder)
    top = stats.top_gaps(stats.gap_pairs(net.nodes, net.edges, clusters, net.n_docs))
    return top.select("term_a", "term_b", F.round("ratio", 6).alias("ratio"), F.round("p_value", 4).alias("p_value"))
