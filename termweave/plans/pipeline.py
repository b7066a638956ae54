"""The whole analysis, step by step, as an API. Each stage's tables are written once and used by all that need them."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators import graph, network, rules, stats
from termweave.plans.corpus import coverage, domain_filter, terms_of
from termweave.session import cut
from termweave.sources import readers, sinks


class NothingLeft(ValueError):
    """No records, no keywords, or none that the filter keeps."""


class TooFewNodes(ValueError):
    """Fewer nodes than a network can be made of; has the suggested threshold."""


@dataclass
class Options:
    keyword_source: str = "keywords"
    counting: str = "full"
    min_occurrences: int = 5
    max_terms: int | None = None
    resolution: float = 1.0
    similarity: float = rules.SIMILARITY
    filter_terms: list[str] = field(default_factory=list)
    exclude_terms: list[str] = field(default_factory=list)
    drop_generic: bool = False
    largest_component: bool = False
    least_nodes: int = 5
    betweenness: bool = True


@dataclass
class Analysis:
    options: Options
    corpus: DataFrame
    frequency: DataFrame
    groups: DataFrame
    candidates: DataFrame
    mapping: DataFrame
    drop: DataFrame
    statuses: DataFrame
    net: network.Network
    assignment: DataFrame
    centrality: DataFrame | None


def analyze(records: DataFrame, options: Options | None = None, thesauri: list[DataFrame] = ()) -> Analysis:
    """Filter, extract, merge and count; build, cluster and measure the network. thesauri: rule tables, later ones win.

    records has doc_id and the canonical columns. Order: domain filter, terms, automatic groups and rules, generic terms,
    network, communities, betweenness. Candidates are only proposed.
    """
    o = options or Options()
    spark = records.sparkSession
    chosen = domain_filter(records, o.filter_terms)
    corpus = cut(chosen.select("doc_id", terms_of(o.keyword_source).alias("terms"), F.nullif("pub_year", F.lit("")).try_cast("int").alias("year"), "citations"), "corpus")
    have = coverage(corpus).first()
    if not have["documents"] or not have["with_terms"]:
        raise NothingLeft(f"{have['documents']} records, {have['with_terms']} with terms")
    frequency = cut(network.document_frequency(corpus), "frequency")
    groups = cut(rules.auto_groups(frequency), "groups")
    candidates = cut(rules.fuzzy_candidates(frequency, _pairs(corpus, frequency), o.similarity), "candidates")
    given = rules.ordered_rules(*thesauri) if thesauri else spark.createDataFrame([], "label string, replace_by string, seq struct<table:int,line:bigint>")
    drop = rules.drop_terms(given)
    if o.exclude_terms:
        drop = drop.unionByName(spark.createDataFrame([(t,) for t in o.exclude_terms], "term string")).distinct()
    drop = cut(drop, "drop")
    mapping = cut(rules.full_mapping(groups, given), "mapping")
    merged, statuses = rules.merge_terms(corpus, mapping, drop)
    merged = cut(merged, "merged")
    blocked = drop
    if o.drop_generic:
        blocked = blocked.unionByName(rules.drop_generic(network.document_frequency(merged))[1].select("term")).distinct()
    net = network.build(merged, o.counting, o.min_occurrences, o.max_terms, blocked)
    if o.largest_component:
        nodes, edges = graph.largest_component(net.nodes, net.edges)
        net = network.Network(cut(nodes, "nodes"), cut(edges, "edges"), net.n_docs, net.counting)
    if net.nodes.count() < o.least_nodes:
        raise TooFewNodes(f"fewer than {o.least_nodes} nodes; min_occurrences {network.suggest_min_occurrences(network.document_frequency(merged))} would give about 60")
    assignment = cut(graph.louvain(net.nodes, net.edges, o.resolution), "assignment")
    centrality = cut(graph.betweenness(net.nodes, net.edges), "centrality") if o.betweenness else None
    return Analysis(o, merged, frequency, groups, candidates, mapping, drop, statuses, net, assignment, centrality)


def _pairs(corpus: DataFrame, frequency: DataFrame) -> DataFrame:
    """(term_a, term_b, n_ab) of the terms that candidates are sought among."""
    top = cut(network.top_terms(frequency, rules.TOP), "top")
    numbered = network.numbered(top)
    edges = network.edges_of(network.present(corpus, cut(numbered, "numbered")))
    named = network.with_labels(edges, numbered)
    return named.select(F.least("label_a", "label_b").alias("term_a"), F.greatest("label_a", "label_b").alias("term_b"), F.col("weight").cast("bigint").alias("n_ab"))


def report(a: Analysis) -> tuple[str, str]:
    """(Markdown, JSON) of an analysis."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    net = a.net
    pairs = cut(stats.gap_pairs(net.nodes, net.edges, a.assignment, net.n_docs, max(2, a.options.min_occurrences)), "gaps")
    summary = stats.network_summary(net.nodes, net.edges, a.assignment, net.n_docs).first().asDict()
    profile = rows(stats.cluster_profile(net.nodes, a.assignment).orderBy(F.desc("size"), "cluster"))
    bridges = [] if a.centrality is None else rows(a.centrality.join(net.nodes.select("id", "label"), "id").orderBy(F.desc("betweenness"), "id").limit(10).select("label", "betweenness"))
    return sinks.analysis_report(summary, rules.merge_stats(a.statuses).first().asDict(), profile, rows(network.strongest(net.edges, net.nodes)), bridges, rows(stats.top_gaps(pairs)), stats.gap_summary(pairs).first().asDict(), asdict(a.options))


def write(a: Analysis, folder: str) -> None:
    """map.txt, network.txt, thesaurus.txt, review.md, report.md and report.json in a folder on the driver."""
    os.makedirs(folder, exist_ok=True)
    nodes = a.net.nodes.join(a.assignment, "id", "left")
    sinks.write_lines(sinks.map_rows(nodes, cluster=True), os.path.join(folder, "map.txt"), ["id"], sinks.map_header(cluster=True))
    sinks.write_lines(sinks.network_rows(a.net.edges), os.path.join(folder, "network.txt"), ["src", "dst"])
    sinks.write_lines(sinks.thesaurus_rows(a.mapping, a.drop), os.path.join(folder, "thesaurus.txt"), ["part", "label"], "label\treplace by")
    texts = dict(zip(("report.md", "report.json"), report(a))) | {"review.md": sinks.review_report(a.frequency, a.groups, a.candidates)}
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)


def register_views(a: Analysis, prefix: str = "") -> list[str]:
    """Temporary views of an analysis for SQL: corpus, terms, nodes, edges, clusters and rules, each name after the prefix."""
    views = {"corpus": a.corpus, "terms": a.frequency, "nodes": a.net.nodes, "edges": a.net.edges, "clusters": a.assignment, "rules": a.mapping}
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]


@dataclass
class Reloaded:
    net: network.Network
    assignment: DataFrame
    layout: bool
    merge: dict


def reload(spark: SparkSession, folder: str, layout: tuple[str, str] | None = None, resolution: float = 1.0) -> Reloaded:
    """The network that write() left in a folder, with its number of documents and merged entries, clustered anew.

    layout names a map file that was laid out elsewhere, and its network file: where its labels are those of the network, its
    places and clusters are taken over; else it is out of date, and layout is False in the result.
    """
    nodes, edges = cut(readers.read_map(spark, os.path.join(folder, "map.txt")), "nodes"), cut(readers.read_network(spark, os.path.join(folder, "network.txt")), "edges")
    if nodes.isEmpty():
        raise NothingLeft(f"no nodes in {folder}")
    try:
        with open(os.path.join(folder, "report.json"), encoding="utf-8") as f:
            meta = json.load(f)
    except (OSError, ValueError):
        meta = {}
    found = cut(readers.read_map(spark, layout[0]), "layout") if layout and os.path.isfile(layout[0]) else None
    fresh = found is not None and network.label_differences(nodes, found).isEmpty()
    if fresh:
        nodes = cut(network.with_layout(nodes, found), "nodes")
        assignment = nodes.select("id", F.col("cluster").cast("bigint").alias("cluster"))
    else:
        assignment = cut(graph.louvain(nodes, edges, resolution), "assignment")
    return Reloaded(network.Network(nodes, edges, int((meta.get("summary") or {}).get("n_docs") or 0)), assignment, fresh, meta.get("merge") or {"merged": 0, "dropped": 0, "kept": 0})
