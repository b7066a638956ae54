"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by source and exact token length. Of each source's budget of tokens every length gets its share, up to
the cap on repeats; what then remains is filled by bounded-knapsack dynamic programming over the uses still free. Only the counts by length are planned on the driver;
which documents of a length are taken is settled by a seeded hash.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.session import broadcast_if_small, cut, spread

#: A public byte-level BPE vocabulary as tiktoken ranks, and the pattern that splits texts for it. Fixed value.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The knapsack starts when at most so many of the longest documents would fit, and at most so many tokens remain; buckets
#: of the seeded choice.
KNAPSACK, MOST_BITS, BUCKETS = 16, 1 << 18, 128

_encodings: dict[int, object] = {}


def _encoding(ranks: bytes):
    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY, name: str = "tokens") -> DataFrame:
    """df with a column of token counts; null texts count 0. Texts are tokenised whole."""
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        enc = _encoding(ranks.value)
        return pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return df.withColumn(name, count(F.col(text)))


@dataclass
class Plan:
    """For one source: its budget, how often documents of each length are used in all, and the tokens of that."""

    budget: int
    uses: dict[int, int]
    tokens: int


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their tokens come as near below budget as can be.

    First each length's share, then the longest that fit in turn until little remains, then the best sum that
    bounded-knapsack dynamic programming finds among what is left. Sums are bits of one integer, so a length of many
    documents costs a few shifts.
    """
    lengths = sorted(n for n in counts if n > 0 and counts[n] > 0)
    total = sum(n * counts[n] for n in lengths)
    if budget <= 0 or not lengths:
        return {}
    if budget >= total:
        return {n: counts[n] for n in lengths}
    take = {n: counts[n] * budget // total for n in lengths}
    left = budget - sum(n * k for n, k in take.items())
    bound = min(KNAPSACK * max((n for n in lengths if n <= left), default=1), MOST_BITS)
    for n in reversed(lengths):
        if left <= bound:
            break
        k = min(counts[n] - take[n], (left - bound + n - 1) // n, left // n)
        take[n] += k
        left -= n * k
    # Bounded knapsack: reach[i] has the sums of the first i parts; parts are powers of two of a length.
    parts = []
    for n in lengths:
        free, size = min(counts[n] - take[n], left // n), 1
        while free > 0:
            k = min(size, free)
            parts.append((n, k))
            free -= k
            size *= 2
    mask, reach = (1 << (left + 1)) - 1, [1]
    for n, k in parts:
        reach.append((reach[-1] | reach[-1] << (n * k)) & mask)
        if reach[-1] >> left & 1:
            break
    at = reach[-1].bit_length() - 1
    for i in range(len(reach) - 1, 0, -1):
        n, k = parts[i - 1]
        if not reach[i - 1] >> at & 1:
            at -= n * k
            take[n] += k
    return {n: k for n, k in take.items() if k}


def plan(histogram: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, Plan]:
    """Plans of the sources. Without a total it is the largest one that all sources with documents can supply.

    Sources without documents get nothing; the shares of the others are then of what they make up together.
    """
    have = {s: sum(n * c for n, c in histogram.get(s, {}).items()) for s in targets}
    able = {s: share for s, (share, cap) in targets.items() if have[s] > 0 and share > 0 and cap > 0}
    whole = sum(able.values())
    if not able:
        return {s: Plan(0, {}, 0) for s in targets}
    most = min(have[s] * targets[s][1] * whole / able[s] for s in able)
    size = most if total is None else min(total, most)
    out = {}
    for s, (_, cap) in targets.items():
        budget = round(size * able[s] / whole) if s in able else 0
        uses = fill({n: c * cap for n, c in histogram[s].items()}, budget) if s in able else {}
        out[s] = Plan(budget, uses, sum(n * k for n, k in uses.items()))
    return out


def mix(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str = "source", total: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(documents, shares): (key, source, tokens, uses) of the documents used, and per target what was reached.

    targets has source, target_share and max_repeats, one row per source; null sources and repeated rows are left out.
    Documents with a null or unlisted source, and empty ones, are not used. The driver gets one row per source and token
    length, a number that the longest document bounds.
    """
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeats").dropDuplicates(["source"]).toLocalIterator()}
    spark = docs.sparkSession
    names = docs.join(broadcast_if_small(spark.createDataFrame([(s,) for s in wanted], f"{source} string")), source, "left_semi")
    counted = cut(token_counts(spread(names.select(key, source, text)), text, vocabulary).select(key, source, "tokens", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)).alias("draw")), "tokens")
    histogram: dict[str, dict[int, int]] = {}
    for r in counted.filter("tokens > 0").groupBy(source, "tokens").count().toLocalIterator():
        histogram.setdefault(r[0], {})[r[1]] = r[2]
    plans = plan(histogram, wanted, total)

    # Documents of a length are all used passes times, and `more` of them once more.
    each = [(s, n, u // histogram[s][n], u % histogram[s][n]) for s, p in plans.items() for n, u in p.uses.items()]
    passes = spark.createDataFrame(each, f"{source} string, tokens long, passes long, more long")
    extra = passes.filter("more > 0").select(source, "tokens", "more")
    # The k documents of a length with the lowest draw: whole buckets of draws, and within one bucket a rank.
    bucket = F.floor(F.col("draw") / F.lit((1 << 40) // BUCKETS))
    rows = counted.filter("tokens > 0").withColumn("bucket", bucket)
    sizes = rows.join(broadcast_if_small(extra), [source, "tokens"]).groupBy(source, "tokens", "bucket").agg(F.count("*").alias("n"), F.first("more").alias("more"))
    upto = F.sum("n").over(Window.partitionBy(source, "tokens").orderBy("bucket"))
    edges = sizes.withColumn("before", upto - F.col("n")).withColumn("from_bucket", F.greatest(F.lit(0), F.least("n", F.col("more") - F.col("before")))).select(source, "tokens", "bucket", "n", "from_bucket")
    edges = cut(edges.filter("from_bucket > 0"), "edges")
    whole = rows.join(edges.filter("from_bucket = n").select(source, "tokens", "bucket"), [source, "tokens", "bucket"], "left_semi").select(key)
    part = rows.join(edges.filter("from_bucket < n"), [source, "tokens", "bucket"]).withColumn("rank", F.row_number().over(Window.partitionBy(source, "tokens", "bucket").orderBy("draw", key))).filter("rank <= from_bucket").select(key)
    once_more = whole.unionByName(part).withColumn("once", F.lit(1))
    used = counted.join(broadcast_if_small(passes), [source, "tokens"]).join(once_more, key, "left")
    chosen = used.select(key, source, "tokens", (F.col("passes") + F.coalesce("once", F.lit(0))).cast("int").alias("uses")).filter("uses > 0")

    sums = chosen.groupBy(source).agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    goal = spark.createDataFrame([(s, float(w[0]), int(w[1]), int(plans[s].budget)) for s, w in wanted.items()], f"{source} string, target_share double, max_repeats int, budget long")
    all_used = sum(p.tokens for p in plans.values())
    shares = goal.join(sums, source, "left").select(source, "target_share", "max_repeats", "budget", F.coalesce("used_tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (F.coalesce("used_tokens", F.lit(0)) / F.lit(max(all_used, 1))).alias("reached_share"))
    return chosen, shares
