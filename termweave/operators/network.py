"""The co-occurrence network: nodes, edges, their measures.

A corpus has (doc_id, terms, year, citations), one row per document. nodes has (id, label, occurrences, total_link_strength,
avg_year, avg_citations), edges has (src, dst, weight) with src < dst. Everything but the edges' pairs is linear in the terms;
terms below the threshold are left out before pairs are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.session import broadcast_if_small, cut

#: Nodes up to which ids are numbered in one sorted partition; more are numbered range by range.
ONE_PARTITION = 1_000_000


def document_frequency(corpus: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term occurs. Null and empty terms are no terms."""
    terms = corpus.select(F.explode(F.array_distinct("terms")).alias("term")).filter("term <> ''")
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary_size(corpus: DataFrame) -> DataFrame:
    """(terms, entries): distinct terms and all entries."""
    return corpus.select(F.explode("terms").alias("term")).filter("term <> ''").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("entries"))


def top_terms(frequency: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms, equal ones by name."""
    return frequency.orderBy(F.desc("df"), "term").limit(n)


def suggest_min_occurrences(frequency: DataFrame, target: int = 60) -> int:
    """The frequency of the term at rank target; 1 where there are no more terms than that."""
    rows = frequency.orderBy(F.desc("df"), "term").offset(target - 1).limit(2).collect()
    return int(rows[0]["df"]) if len(rows) == 2 else 1


def kept_terms(corpus: DataFrame, min_occurrences: int = 2, max_terms: int | None = None, drop: DataFrame | None = None) -> DataFrame:
    """(term, df) of the terms that become nodes. drop has a column term; it is compared exactly."""
    frequency = document_frequency(corpus)
    if drop is not None:
        frequency = frequency.join(drop.select("term"), "term", "left_anti")
    frequency = frequency.filter(F.col("df") >= min_occurrences)
    return top_terms(frequency, max_terms) if max_terms else frequency


def row_numbers(df: DataFrame, order: list[Column], name: str, one_partition: int = ONE_PARTITION) -> DataFrame:
    """df, a written table, with numbers from 1 in an order that has no ties; more rows than one partition takes range by range."""
    if df.count() <= one_partition:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    parts = cut(df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism * 4, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).select("_part", "_before")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_at", at).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_before")  # a row per range


def numbered(kept: DataFrame) -> DataFrame:
    """(id, label, occurrences): ids from 1 by falling frequency, equal ones by name. kept is a written table."""
    out = row_numbers(kept, [F.desc("df"), F.asc("term")], "id")
    return out.select("id", F.col("term").alias("label"), F.col("df").alias("occurrences"))


def present(corpus: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, ids): per document the ids of its nodes in rising order; documents without any are left out."""
    rows = corpus.select("doc_id", F.explode(F.array_distinct("terms")).alias("label"))
    met = rows.join(broadcast_if_small(nodes.select("id", "label")), "label")
    return met.groupBy("doc_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def edges_of(docs: DataFrame, counting: str = "full") -> DataFrame:
    """(src, dst, weight): summed over documents. full and binary count a pair once per document; fractional as 1/(k-1).

    k is the number of the document's nodes. A document's pairs are made first item by first item, so that a long one needs
    no array of all its pairs.
    """
    weight = 1 / (F.size("ids") - 1).cast("double") if counting == "fractional" else F.lit(1.0)
    many = docs.filter(F.size("ids") > 1).select("ids", weight.alias("w"))
    first = many.select("ids", "w", F.posexplode("ids").alias("i", "src"))
    pairs = first.select("src", "w", F.explode(F.slice("ids", F.col("i") + 2, F.greatest(F.size("ids") - F.col("i") - 1, F.lit(0)))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, weight) from either end."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), "weight"), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), "weight"))).alias("_e")).select("_e.*")


def link_strength(edges: DataFrame) -> DataFrame:
    """(id, total_link_strength)."""
    return both_ways(edges).groupBy("id").agg(F.sum("weight").alias("total_link_strength"))


def averages(corpus: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, avg_year, avg_citations) over the documents that have a value; 0.0 where none has. Year 0 is no year."""
    known = docs.join(corpus.select("doc_id", F.nullif(F.col("year").cast("double"), F.lit(0.0)).alias("year"), F.col("citations").cast("double").alias("citations")), "doc_id")
    rows = known.select(F.explode("ids").alias("id"), "year", "citations")
    return rows.groupBy("id").agg(F.coalesce(F.avg("year"), F.lit(0.0)).alias("avg_year"), F.coalesce(F.avg("citations"), F.lit(0.0)).alias("avg_citations"))


def node_documents(docs: DataFrame) -> DataFrame:
    """(id, doc_id): the documents of each node, as rows."""
    return docs.select(F.explode("ids").alias("id"), "doc_id")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree, neighbors): number of neighbours, and their ids in rising order."""
    return both_ways(edges.filter("weight > 0")).groupBy("id").agg(F.count("*").alias("degree"), F.array_sort(F.collect_list("other")).alias("neighbors"))


@dataclass
class Network:
    nodes: DataFrame
    edges: DataFrame
    n_docs: int
    counting: str = "full"


def build(corpus: DataFrame, counting: str = "full", min_occurrences: int = 2, max_terms: int | None = None, drop: DataFrame | None = None, measures: bool = True) -> Network:
    """The network of a corpus, which is read several times. Documents without terms count as documents.

    nodes and edges are written tables. Without measures the nodes have neither strengths nor averages, and n_docs is -1.
    """
    kept = cut(kept_terms(corpus, min_occurrences, max_terms, drop), "kept")
    nodes = cut(numbered(kept), "numbered")
    docs = present(corpus, nodes)
    if not measures:
        return Network(nodes, cut(edges_of(docs, counting), "edges"), -1, counting)
    docs = cut(docs, "present")
    edges = cut(edges_of(docs, counting), "edges")
    whole = nodes.join(link_strength(edges), "id", "left").join(averages(corpus, docs), "id", "left")
    nodes = cut(whole.select("id", "label", "occurrences", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total_link_strength", "avg_year", "avg_citations")]), "nodes")
    return Network(nodes, edges, corpus.count(), counting)


def with_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with label_a, label_b, occ_a, occ_b and association_strength, weight / (occ_a * occ_b)."""
    small = broadcast_if_small(nodes.select("id", "label", "occurrences"))
    a = small.select(F.col("id").alias("src"), F.col("label").alias("label_a"), F.col("occurrences").alias("occ_a"))
    b = small.select(F.col("id").alias("dst"), F.col("label").alias("label_b"), F.col("occurrences").alias("occ_b"))
    return edges.join(a, "src").join(b, "dst").withColumn("association_strength", F.col("weight") / (F.col("occ_a") * F.col("occ_b")))


def strongest(edges: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    """The n strongest edges with names, equal ones by id."""
    top = edges.filter("weight > 0").orderBy(F.desc("weight"), "src", "dst").limit(n)
    return with_labels(top, nodes).select("label_a", "label_b", "weight", "association_strength")


def with_layout(nodes: DataFrame, layout: DataFrame) -> DataFrame:
    """Nodes with x, y and cluster of a layout (id, x, y, cluster) made elsewhere; without a place there 0, 0 and cluster 1."""
    kept = nodes.drop("x", "y", "cluster")
    places = layout.select("id", "x", "y", "cluster")
    return kept.join(places, "id", "left").fillna(0.0, ["x", "y"]).fillna(1, ["cluster"])


def label_differences(nodes: DataFrame, other: DataFrame) -> DataFrame:
    """(label, missing): labels that only one of two node tables has; none if one may be used for the other."""
    only = nodes.select("label").distinct().exceptAll(other.select("label").distinct()).withColumn("missing", F.lit("other"))
    return only.unionByName(other.select("label").distinct().exceptAll(nodes.select("label").distinct()).withColumn("missing", F.lit("nodes")))
