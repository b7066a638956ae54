"""Sinks: map, network, thesaurus and colour files as rows of text, reports as text. A byte order mark starts each file."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Colours of clusters, cycled. Fixed values.
PALETTE = ((225, 131, 47), (162, 152, 223), (204, 65, 192), (3, 60, 96), (229, 255, 67), (0, 128, 128), (220, 20, 60), (60, 179, 113), (255, 165, 0), (106, 90, 205), (70, 130, 180), (178, 34, 34))


def _fixed(col: Column | str, digits: int) -> Column:
    """Decimal text of the exact binary value; the JVM's formatting rounds the shortest decimal form instead."""

    @F.arrow_udf(T.StringType())
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    return text(F.col(col).cast("double") if isinstance(col, str) else col.cast("double"))


def _number(col: Column) -> Column:
    """Whole numbers without decimals, others with four."""
    return F.when(col == F.floor(col), F.format_string("%.0f", col)).otherwise(_fixed(col, 4))


def map_header(layout: bool = False, cluster: bool = False, year: bool = True, citations: bool = True) -> str:
    names = ["id", "label", "description", *(["x", "y"] if layout else []), *(["cluster"] if cluster else []), "weight<Occurrences>", "weight<Total link strength>"]
    return "\t".join(names + (["score<Avg. pub. year>"] if year else []) + (["score<Avg. citations>"] if citations else []))


def map_rows(nodes: DataFrame, layout: bool = False, cluster: bool = False, year: bool = True, citations: bool = True) -> DataFrame:
    """(id, line) of a map file. Averages of 0 are blank, cluster 0 or null is 1."""
    cells = [F.col("id").cast("string"), F.col("label"), F.lit("")]
    if layout:
        cells += [_fixed(F.coalesce("x", F.lit(0.0)), 4), _fixed(F.coalesce("y", F.lit(0.0)), 4)]
    if cluster:
        cells.append(F.when(F.coalesce("cluster", F.lit(0)) == 0, "1").otherwise(F.col("cluster").cast("string")))
    cells += [F.col("occurrences").cast("string"), _fixed("total_link_strength", 0)]
    if year:
        cells.append(F.when(F.col("avg_year") != 0, _fixed("avg_year", 1)).otherwise(""))
    if citations:
        cells.append(F.when(F.col("avg_citations") != 0, _fixed("avg_citations", 2)).otherwise(""))
    return nodes.select("id", F.concat_ws("\t", *cells).alias("line"))


def network_rows(edges: DataFrame) -> DataFrame:
    """(src, dst, line) of a sparse network file; edges without weight are left out."""
    return edges.filter("weight > 0").select("src", "dst", F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), _number(F.col("weight"))).alias("line"))


def dense_rows(nodes: DataFrame, edges: DataFrame, most: int = 2000) -> DataFrame:
    """(id, line): one row of the matrix per node, with the weight to every node in order of ids, 0 where there is no edge.

    A matrix has a column per node, so networks of more than `most` nodes are refused; the sparse form has no such bound.
    """
    ids = [r[0] for r in nodes.select("id").orderBy("id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} nodes: write the sparse form")
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "weight"))
    wide = nodes.select("id").join(both.groupBy("id").pivot("other", ids).agg(F.sum("weight")), "id", "left").fillna(0.0)
    return wide.select("id", F.concat_ws("\t", F.col("id").cast("string"), *[_number(F.col(f"`{i}`")) for i in ids]).alias("line"))


def thesaurus_rows(mapping: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """(part, label, line): rules that change a label, then deleted terms."""
    rules = mapping.filter("label <> target").select(F.lit(0).alias("part"), "label", F.concat_ws("\t", "label", "target").alias("line"))
    if drop is None:
        return rules
    return rules.unionByName(drop.select(F.lit(1).alias("part"), F.col("term").alias("label"), F.concat("term", F.lit("\t")).alias("line")))


def cluster_colors(clusters: DataFrame) -> DataFrame:
    """(cluster, red, green, blue)."""
    palette = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("red", "green", "blue"), c)]) for c in PALETTE])
    return clusters.select("cluster").distinct().select("cluster", F.element_at(palette, (F.pmod(F.col("cluster") - 1, F.lit(len(PALETTE))) + 1).cast("int")).alias("_c")).select("cluster", "_c.*")


def color_rows(clusters: DataFrame) -> DataFrame:
    """(cluster, line) of a file of cluster colours; its header is COLOR_HEADER."""
    return cluster_colors(clusters).select("cluster", F.concat_ws("\t", *[F.col(c).cast("string") for c in ("cluster", "red", "green", "blue")]).alias("line"))


COLOR_HEADER, OVERLAY_HEADER = "cluster\tred\tgreen\tblue", "color value\tred\tgreen\tblue"


def overlay_rows(spark: SparkSession, stops: list[tuple[float, tuple[int, int, int]]]) -> DataFrame:
    """(value, line) of a file of overlay colours from (value between 0 and 1, (red, green, blue)); the header is OVERLAY_HEADER."""
    return spark.createDataFrame([(float(v), "\t".join(map(str, (float(v), *c)))) for v, c in stops], "value double, line string")


def works_table(records: DataFrame) -> DataFrame:
    """Records with the columns of a table that the readers know by header; lists are joined with '; '."""
    return records.select(
        F.col("title").alias("Title"), F.concat_ws("; ", "authors").alias("Authors"), F.col("source").alias("Source title"), F.col("pub_year").alias("Year"), F.col("citations").alias("Cited by"),
        F.col("doi").alias("DOI"), F.concat_ws("; ", "keywords").alias("Author Keywords"), F.concat_ws("; ", "keywords_plus").alias("Index Keywords"), F.col("abstract").alias("Abstract"),
    )


def write_works(records: DataFrame, folder: str) -> None:
    """CSV files of records with a header, one per partition, quoted where needed; read_bib reads the folder back."""
    works_table(records).write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


def write_lines(rows: DataFrame, path: str, order: list[str], header: str | None = None) -> None:
    """One file with the rows' lines in order; rows are streamed through the driver, partition by partition."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        if header is not None:
            f.write(header + "\n")
        for r in rows.orderBy(*order).select("line").toLocalIterator():
            f.write(r[0] + "\n")


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(x) for x in row) + " |" for row in rows)]


def review_report(frequency: DataFrame, groups: DataFrame, candidates: DataFrame, top: int = 60) -> str:
    """Markdown for the review of synonyms: groups merged, candidates, frequent terms; each list cut at a fixed length."""
    size = frequency.agg(F.count("*"), F.sum("df")).first()
    merged = groups.groupBy("canonical").agg(F.max("canonical_df").alias("df"), F.array_sort(F.collect_list("member")).alias("members")).orderBy(F.desc("df"), "canonical").limit(top).collect()
    open_ = candidates.orderBy(F.col("rate").asc_nulls_last(), "kind", "canonical").limit(top).collect()
    frequent = frequency.orderBy(F.desc("df"), "term").limit(40).collect()
    out = ["# Synonyms to review", "", f"{size[0]} terms, {size[1] or 0} occurrences by document.", "", "## Merged: same key", ""]
    out += _table(["term", "spellings"], [[r["canonical"], "; ".join(r["members"])] for r in merged])
    out += ["", "## Candidates: a low rate of common documents speaks for one term, a high one for two", ""]
    out += _table(["term", "may include", "rate", "why"], [[r["canonical"], r["member"], "" if r["rate"] is None else f"{r['rate']:.2f}", r["kind"]] for r in open_])
    out += ["", "## Most frequent terms", ""] + _table(["term", "documents"], [[r["term"], r["df"]] for r in frequent])
    return "\n".join(out) + "\n"


def analysis_report(summary: dict, merge: dict, profile: list[dict], edges: list[dict], bridges: list[dict], gaps: list[dict], tested: dict, params: dict) -> tuple[str, str]:
    """(Markdown, JSON) of an analysis; says what was computed here and nothing else."""
    out = ["# Co-occurrence analysis", "", "## Corpus and network", ""]
    out += _table(["measure", "value"], [[k, v] for k, v in {**summary, **{f"entries {k}": v for k, v in merge.items()}}.items()])
    out += ["", "Communities are found by local moving for modularity; the modularity given is at resolution 1. Candidates for synonyms are listed for review and not applied.", "", "## Clusters", ""]
    out += _table(["cluster", "terms", "strongest", "mean year", "mean citations"], [[c["cluster"], c["size"], "; ".join(c["top_terms"]), "" if c["avg_year"] is None else f"{c['avg_year']:.1f}", "" if c["avg_citations"] is None else f"{c['avg_citations']:.2f}"] for c in profile])
    out += ["", "## Strongest pairs", ""] + _table(["a", "b", "weight", "association strength"], [[e["label_a"], e["label_b"], f"{e['weight']:.1f}", f"{e['association_strength']:.5f}"] for e in edges])
    out += ["", "## Bridging terms", ""] + _table(["term", "betweenness"], [[b["label"], f"{b['betweenness']:.4f}"] for b in bridges])
    out += ["", "## Pairs of clusters' terms found together less than by chance", "", f"{tested['n_tested']} pairs tested, {tested['n_significant']} significant; no correction for multiple tests.", ""]
    out += _table(["a", "b", "clusters", "found", "expected", "ratio", "p"], [[g["term_a"], g["term_b"], f"{g['cluster_a']} / {g['cluster_b']}", f"{g['actual']:.2f}", f"{g['expected']:.2f}", f"{g['ratio']:.3f}", f"{g['p_value']:.4f}"] for g in gaps if g["significant"]])
    weak = [g for g in gaps if not g["significant"]][:10]
    if weak:
        out += ["", "Not significant, and so no evidence:", ""] + _table(["a", "b", "found", "expected", "p"], [[g["term_a"], g["term_b"], f"{g['actual']:.2f}", f"{g['expected']:.2f}", f"{g['p_value']:.4f}"] for g in weak])
    data = {"summary": summary, "merge": merge, "clusters": profile, "strongest": edges, "bridges": bridges, "gaps": gaps, "tested": tested, "params": params}
    return "\n".join(out) + "\n", json.dumps(data, ensure_ascii=False, indent=2, default=str)
