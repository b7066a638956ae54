"""Synonym rules: discovery, candidates for review, resolution, application, generic terms.

Rules have (label, replace_by, seq); a blank or null replace_by deletes the label. Later rules (greater seq) win.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.functions import text
from termweave.operators.network import top_terms
from termweave.session import broadcast_if_small, cut

#: Defaults of the candidate search.
SIMILARITY, TOP = 0.88, 300


def keyed(frequency: DataFrame) -> DataFrame:
    """(term, df, key): the comparison key after the equivalence rules."""
    return frequency.withColumn("key", text.key_form(text.equivalents(F.col("term"))))


def auto_groups(frequency: DataFrame, min_count: int = 1) -> DataFrame:
    """(canonical, member, canonical_df, member_df): terms that share a key lead to the most frequent of them, ties by name."""
    rows = keyed(frequency.filter(F.col("df") >= min_count))
    best = rows.groupBy("key").agg(F.min(F.struct((-F.col("df")).alias("neg"), F.col("term").alias("term"))).alias("best"))
    met = rows.join(best, "key").filter(F.col("term") != F.col("best.term"))
    return met.select(F.col("best.term").alias("canonical"), F.col("term").alias("member"), (-F.col("best.neg")).alias("canonical_df"), F.col("df").alias("member_df"))


@F.arrow_udf(T.DoubleType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


_ratio_once = _ratio.asNondeterministic()


def fuzzy_candidates(frequency: DataFrame, pair_counts: DataFrame | None = None, threshold: float = SIMILARITY, top: int = TOP, kinds: tuple[str, ...] = ("containment", "similarity")) -> DataFrame:
    """(canonical, member, kind, similarity, rate): pairs of frequent terms that may be one, for review.

    Only the `top` most frequent terms are compared, pair by pair: that is the feature, and bounds the pairs. pair_counts
    has (term_a, term_b, n_ab) with term_a < term_b; rate is n_ab over the smaller frequency, null without pair_counts.
    Of the pairs of one canonical term the one with the lowest rate, rounded to three places, is kept.
    """
    ranked = top_terms(frequency, top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "term"))).withColumn("key", text.key_form(F.col("term")))
    ranked = cut(ranked, "ranked")
    a = ranked.select(F.col("term").alias("a"), F.col("df").alias("df_a"), F.col("rank").alias("rank_a"), F.col("key").alias("key_a"))
    b = ranked.select(F.col("term").alias("b"), F.col("df").alias("df_b"), F.col("rank").alias("rank_b"), F.col("key").alias("key_b"))
    pairs = a.join(F.broadcast(b), (F.col("rank_a") < F.col("rank_b")) & (F.col("key_a") != F.col("key_b")))
    la, lb = F.length("key_a"), F.length("key_b")
    within = (la >= 3) & (lb >= 3) & (F.col("key_a").contains(F.col("key_b")) | F.col("key_b").contains(F.col("key_a")))
    parts = []
    if "containment" in kinds:
        parts.append(pairs.filter(within).withColumn("kind", F.lit("containment")).withColumn("similarity", F.lit(0.0)))
    if "similarity" in kinds:
        near = (F.abs(la - lb) <= F.greatest(F.lit(5), F.floor(la * 0.4))) & ((F.substring("key_a", 1, 1) == F.substring("key_b", 1, 1)) | F.col("key_a").startswith(F.col("key_b")) | F.col("key_b").startswith(F.col("key_a")))
        parts.append(pairs.filter(~within & near).withColumn("kind", F.lit("similarity")).withColumn("similarity", _ratio_once("key_a", "key_b")).filter(F.col("similarity") >= threshold))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = (F.col("df_a") > F.col("df_b")) | ((F.col("df_a") == F.col("df_b")) & (F.length("a") <= F.length("b")))
    named = found.withColumn("canonical", F.when(first, F.col("a")).otherwise(F.col("b"))).withColumn("member", F.when(first, F.col("b")).otherwise(F.col("a")))
    if pair_counts is None:
        rated = named.withColumn("rate", F.lit(None).cast("double"))
    else:
        met = named.join(pair_counts, (F.least("a", "b") == F.col("term_a")) & (F.greatest("a", "b") == F.col("term_b")), "left")
        rated = met.withColumn("rate", F.round(F.coalesce("n_ab", F.lit(0)) / F.least("df_a", "df_b"), 3))
    order = F.row_number().over(Window.partitionBy("canonical").orderBy(F.col("rate").asc_nulls_last(), "rank_a", "rank_b"))
    return rated.withColumn("_n", order).filter("_n = 1").select("canonical", "member", "kind", "similarity", "rate")


def ordered_rules(*tables: DataFrame) -> DataFrame:
    """Rules of several tables (label, replace_by), the later table winning, with seq. Labels are trimmed, blank ones left out."""
    out = None
    for i, t in enumerate(tables):
        seq = F.struct(F.lit(i).alias("table"), (F.col("seq") if "seq" in t.columns else F.lit(0)).cast("bigint").alias("line"))
        rows = t.select(F.trim("label").alias("label"), F.trim(F.coalesce("replace_by", F.lit(""))).alias("replace_by"), seq.alias("seq")).filter("label <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_terms(rules: DataFrame) -> DataFrame:
    """(term): labels that any rule deletes; a rule elsewhere doesn't bring them back."""
    return rules.filter(F.coalesce("replace_by", F.lit("")) == "").select(F.col("label").alias("term")).distinct()


def winning(rules: DataFrame) -> DataFrame:
    """(label, target): of each label the last rule that replaces it."""
    return rules.filter("replace_by <> ''").groupBy("label").agg(F.max_by("replace_by", "seq").alias("target"))


def resolve(mapping: DataFrame) -> DataFrame:
    """(label, target): every label with the end of its chain; a cycle ends in its least member; labels that end in themselves
    are left out.

    Pointer doubling: each round doubles the length of the chains followed, so the rounds are logarithmic in the longest one.
    A chain that has not ended when all chains must have runs into a cycle; the least label met on it is its end.
    """
    step = cut(mapping.select("label", "target", F.least("label", "target").alias("least")), "step")
    rounds = max(1, step.count()).bit_length() + 1
    for _ in range(rounds):
        on = step.select(F.col("label").alias("target"), F.col("target").alias("further"), F.col("least").alias("least_on"))
        joined = step.join(on, "target", "left")
        open_ = joined.filter("further IS NOT NULL AND further <> target").limit(1).count() > 0
        if not open_:
            break
        step = cut(joined.select("label", F.coalesce("further", "target").alias("target"), F.when(F.col("further").isNotNull(), F.least("least", "least_on")).otherwise(F.col("least")).alias("least")), "step")
    # Ends that still lead on lie on cycles; 'least' of such an end has seen its whole cycle.
    cyclic = step.select(F.col("label").alias("target"), F.col("least").alias("cycle_end"))
    out = step.join(cyclic, "target", "left").select("label", F.coalesce("cycle_end", "target").alias("target"))
    return out.filter("label <> target")


def full_mapping(auto: DataFrame | None, rules: DataFrame | None) -> DataFrame:
    """(label, target): automatic groups and rules together, the rules first, chains resolved.

    An automatic rule for a term that a rule names as its target is left out, so that the two can't turn against each other.
    """
    mapping = None
    if rules is not None:
        mapping = winning(rules)
    if auto is not None:
        own = auto.select(F.col("member").alias("label"), F.col("canonical").alias("target"))
        if mapping is not None:
            own = own.join(mapping.select(F.col("target").alias("label")).distinct(), "label", "left_anti").join(mapping.select("label"), "label", "left_anti")
            mapping = mapping.unionByName(own)
        else:
            mapping = own
    return resolve(mapping)


def with_normal_forms(mapping: DataFrame) -> DataFrame:
    """(label, target): a resolved mapping whose labels' normal forms are labels too, where no rule has them.

    Of several labels with one normal form the last by name counts. Chains are resolved once more, so that a target which is
    a label in normal form only is followed.
    """
    exact = cut(mapping.select("label", "target"), "exact")
    forms = exact.select(text.normalize(F.col("label")).alias("form"), "label", "target").groupBy("form").agg(F.max_by("target", "label").alias("target"))
    return resolve(exact.unionByName(forms.select(F.col("form").alias("label"), "target").join(exact.select("label"), "label", "left_anti")))


def merge_terms(corpus: DataFrame, mapping: DataFrame, drop: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(corpus, statuses): terms rewritten by a resolved mapping, those dropped left out, each kept once in its first place.

    A term is looked up as it is, then in its normal form. A term that leads to a dropped one is dropped too. Documents left
    without terms keep an empty list. statuses has (term, target, status, n) per distinct term; its n are entries before
    repeated ones are joined.
    """
    entries = corpus.select("doc_id", F.posexplode("terms").alias("pos", "raw")).withColumn("term", F.trim("raw")).filter("term <> ''")
    words = cut(entries.groupBy("term").agg(F.count("*").alias("n")).withColumn("normal", text.normalize(F.col("term"))), "words")
    labels = cut(with_normal_forms(mapping), "labels")
    small = broadcast_if_small(labels)
    exact = small.select(F.col("label").alias("term"), F.col("target").alias("exact"))
    by_normal = small.select(F.col("label").alias("normal"), F.col("target").alias("by_normal"))
    found = words.join(exact, "term", "left").join(by_normal, "normal", "left")
    found = found.withColumn("target", F.coalesce("exact", "by_normal")).withColumn("target_normal", text.normalize(F.col("target")))
    if drop is not None:
        blocked = cut(drop.select(text.normalize(F.col("term")).alias("blocked")).distinct(), "blocked")
        small = broadcast_if_small(blocked)
        found = found.join(small.withColumnRenamed("blocked", "b1"), F.col("normal") == F.col("b1"), "left").join(small.withColumnRenamed("blocked", "b2"), F.col("target_normal") == F.col("b2"), "left")
    else:
        found = found.withColumn("b1", F.lit(None).cast("string")).withColumn("b2", F.lit(None).cast("string"))
    moved = F.col("target").isNotNull() & (F.col("target") != F.col("term"))
    status = F.when(F.col("b1").isNotNull() | (moved & F.col("b2").isNotNull()), "dropped").when(moved, "merged").otherwise("kept")
    statuses = cut(found.select("term", F.when(moved, F.col("target")).otherwise(F.col("term")).alias("target"), status.alias("status"), "n"), "statuses")
    kept = entries.join(broadcast_if_small(statuses.select("term", "target", "status")), "term").filter("status <> 'dropped'")
    lists = kept.groupBy("doc_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"])).alias("terms"))
    rest = [c for c in corpus.columns if c != "terms"]
    merged = corpus.select(*rest).join(lists, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return merged.select(*corpus.columns), statuses


def merge_stats(statuses: DataFrame) -> DataFrame:
    """(merged, dropped, kept): numbers of entries."""
    return statuses.agg(*[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).cast("bigint").alias(s) for s in ("merged", "dropped", "kept")])


def generic_terms(spark, extra: list[str] = ()) -> DataFrame:
    """(normal): normal forms of the generic terms and of extra ones."""
    forms = sorted({text.comparison_form(t) for t in [*text.GENERIC_EN, *text.GENERIC_ZH, *extra]})
    return spark.createDataFrame([(t,) for t in forms], "normal string")


def drop_generic(frequency: DataFrame, extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) terms of a frequency table, split by whether their normal form is a generic term."""
    rows = frequency.withColumn("normal", text.normalize(F.col("term")))
    generic = F.broadcast(generic_terms(frequency.sparkSession, extra))  # some 170 rows, by the list above
    return rows.join(generic, "normal", "left_anti").drop("normal"), rows.join(generic, "normal", "left_semi").drop("normal")
