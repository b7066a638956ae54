"""Measures of a clustered network: modularity, profiles, gaps, summary. assignment has (id, cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.statistics import hypergeometric_tail, verdict
from termweave.operators.network import both_ways, strongest, with_labels
from termweave.session import broadcast_if_small

#: A pair is a gap candidate if at least so many common documents are expected and the share of them found is below this.
EXPECTED, RATIO, ALPHA = 1.0, 0.35, 0.05
#: Shares of the nodes of one power of two, so that a common one doesn't meet all others in one task.
SHARES = 16


def modularity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(q): weighted modularity of an assignment at resolution 1; 0 without edges."""
    small = broadcast_if_small(assignment.select("id", "cluster"))
    a, b = small.select(F.col("id").alias("src"), F.col("cluster").alias("ca")), small.select(F.col("id").alias("dst"), F.col("cluster").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = both_ways(edges).join(small, "id").groupBy("cluster").agg(F.sum("weight").alias("ends"))
    m = edges.agg(F.sum("weight").alias("m"))
    parts = ends.join(inside, ends["cluster"] == inside["ca"], "left").crossJoin(F.broadcast(m))
    return parts.agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - (F.col("ends") / (2 * F.col("m"))) ** 2), F.lit(0.0)).alias("q"))


def cluster_profile(nodes: DataFrame, assignment: DataFrame, top: int = 8) -> DataFrame:
    """(cluster, size, top_terms, total_occurrences, avg_year, avg_citations), averages over nodes that have a value.

    top_terms are the strongest linked ones, equal ones by id; ranks are made per cluster, so none is gathered whole.
    """
    rows = nodes.join(assignment.select("id", "cluster"), "id")
    sums = rows.groupBy("cluster").agg(
        F.count("*").alias("size"),
        F.sum("occurrences").alias("total_occurrences"),
        F.avg(F.when(F.col("avg_year") > 0, F.col("avg_year"))).alias("avg_year"),
        F.avg(F.when(F.col("avg_citations") > 0, F.col("avg_citations"))).alias("avg_citations"),
    )
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("total_link_strength"), "id"))
    best = rows.select("cluster", "id", "label", "total_link_strength").withColumn("rank", rank).filter(F.col("rank") <= top)
    names = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("top_terms"))
    return sums.join(names, "cluster").select("cluster", "size", "top_terms", "total_occurrences", "avg_year", "avg_citations")


def gap_pairs(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, n_docs: int, min_occurrences: int = 2, alpha: float = ALPHA) -> DataFrame:
    """All tested pairs: (id_a, id_b, term_a, term_b, cluster_a, cluster_b, occ_a, occ_b, actual, expected, ratio, p_value, significant).

    Pairs of nodes in different clusters, each with min_occurrences, of which at least one common document is expected and
    less than 0.35 of the expected ones are found; a missing edge counts 0. Every such pair is asked for, so their number is
    quadratic in the nodes with enough occurrences: the expectation bounds it, as occ_a * occ_b must reach n_docs. Nodes meet
    by the power of two of their occurrences, only where two powers together can reach that, in SHARES of each.
    """
    kept = nodes.filter(F.col("occurrences") >= min_occurrences).join(assignment.select("id", "cluster"), "id").withColumn("band", F.floor(F.log2("occurrences")).cast("int"))
    side = lambda s: [F.col("id").alias(f"id_{s}"), F.col("label").alias(f"term_{s}"), F.col("cluster").alias(f"cluster_{s}"), F.col("occurrences").alias(f"occ_{s}")]
    top = max(1, int(n_docs)).bit_length()
    # 2^(band + 1) times 2^(other + 1) must exceed n_docs.
    least = F.greatest(F.lit(0), F.ceil(F.log2(F.lit(float(max(1, n_docs))))).cast("int") - F.col("band") - 2)
    a = kept.select(*side("a"), F.explode(F.when(least <= top, F.sequence(least, F.lit(top))).otherwise(F.array().cast("array<int>"))).alias("band"), F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int").alias("share"))
    b = kept.select(*side("b"), "band", F.explode(F.array(*map(F.lit, range(SHARES)))).alias("share"))
    pairs = a.join(b, ["band", "share"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("cluster_a") != F.col("cluster_b")) & (F.col("occ_a") * F.col("occ_b") >= F.lit(EXPECTED * n_docs))).drop("band", "share")
    found = pairs.join(edges.select(F.col("src").alias("id_a"), F.col("dst").alias("id_b"), "weight"), ["id_a", "id_b"], "left")
    measured = found.withColumn("actual", F.coalesce("weight", F.lit(0.0))).withColumn("expected", F.col("occ_a") * F.col("occ_b") / F.lit(float(n_docs))).withColumn("ratio", F.col("actual") / F.col("expected"))
    tested = measured.filter(F.col("ratio") < RATIO).withColumn("p_value", hypergeometric_tail(F.lit(n_docs), F.col("occ_a"), F.col("occ_b"), F.col("actual").cast("bigint")))
    return tested.withColumn("significant", F.col("p_value") < alpha).drop("weight")


def top_gaps(pairs: DataFrame, n: int = 15) -> DataFrame:
    """The n first pairs: significant ones first, then by p rounded to four places, then by ids."""
    return pairs.orderBy(F.desc("significant"), F.bround("p_value", 4), "id_a", "id_b").limit(n)


def gap_summary(pairs: DataFrame) -> DataFrame:
    """(n_tested, n_significant)."""
    return pairs.agg(F.count("*").alias("n_tested"), F.count_if("significant").alias("n_significant"))


def network_summary(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, n_docs: int) -> DataFrame:
    """One row: (n_docs, n_nodes, n_edges, n_clusters, q, verdict, mean_association)."""
    linked = with_labels(edges.filter("weight > 0"), nodes)
    q = modularity(edges, assignment)
    out = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(linked.agg(F.count("*").alias("n_edges"), F.coalesce(F.avg("association_strength"), F.lit(0.0)).alias("mean_association")))
    out = out.crossJoin(assignment.agg(F.count_distinct("cluster").alias("n_clusters"))).crossJoin(q)
    return out.select(F.lit(n_docs).cast("bigint").alias("n_docs"), "n_nodes", "n_edges", "n_clusters", "q", verdict(F.col("q")).alias("verdict"), "mean_association")


__all__ = ["modularity", "cluster_profile", "gap_pairs", "top_gaps", "gap_summary", "network_summary", "strongest"]
