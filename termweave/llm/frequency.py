"""Frequency of every distinct value: recursive radix spilling with DuckDB as the aggregator.

Entries are combined on the map side first, so that a term holding a third of all rows reaches the exchange once per input
partition. The partial counts are written to the shared folder, one folder per value of the leading bits of the term's hash.
Folders with more rows than one aggregation takes, and only those, are read again and written by more bits, until each fits.
Then DuckDB aggregates the files of every folder by itself, streaming them and spilling to the shared folder.
"""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.session import new_path

#: Rows of partial counts that one aggregation takes; bits of each further split; bits of a first and of a last split at most.
BUCKET_ROWS, MORE_BITS, FIRST_BITS, LAST_BITS = 1_000_000, 3, 14, 60
#: Memory of one aggregation, beyond which DuckDB spills.
MEMORY = "512MB"

_COUNTS = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("units", pa.int64())])


def record_counts(df: DataFrame, unit: str, terms: str) -> DataFrame:
    """(term, occurrences, units): of each term of an array column its entries and, as each row is one unit, its units per row.

    Null terms and terms that are empty are no terms. One row per entry, a row's first entry of a term with units 1, the
    others with 0; combined per partition by count_terms.
    """
    items = F.sort_array(F.filter(F.col(terms), lambda t: t.isNotNull() & (t != "")))
    one = df.select(items.alias("_items")).select(
        F.explode(F.transform("_items", lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & (F.get("_items", i - 1) == t), 0).otherwise(1).cast("long").alias("units")))).alias("_x")
    )
    return one.select("_x.term", F.lit(1).cast("long").alias("occurrences"), "_x.units")


def first_bits(spark: SparkSession) -> int:
    """Hash bits of a first split: four folders or more for each core."""
    return min(FIRST_BITS, math.ceil(math.log2(4 * max(1, spark.sparkContext.defaultParallelism))))


def _spill(partial: DataFrame, bits: int) -> str:
    """Write partial counts by the leading bits of the hash, in folders bucket=N; those that meet in a task are combined."""
    digest = F.xxhash64("term")
    path = new_path(partial.sparkSession, f"radix{bits}")
    # Two more bits part a bucket among tasks, each of which writes one file of it.
    parted = partial.repartition(F.shiftrightunsigned(digest, 62 - bits))
    _combined(parted).withColumn("bucket", F.shiftrightunsigned(F.xxhash64("term"), 64 - bits)).write.partitionBy("bucket").parquet(path)
    return path


def _aggregated(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(term, occurrences, units): DuckDB sums each folder of partial counts by itself."""
    if not folders:
        return spark.createDataFrame([], "term string, occurrences long, units long")
    shared = new_path(spark, "spill").removeprefix("file://")

    def work(batches):
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for n in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(folders[n]) if "://" in folders[n] else (fs.LocalFileSystem(), folders[n])
                files = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
                # DuckDB spills to a mounted folder only; in another store the number of rows bounds what it holds.
                spill = f"{shared}/{uuid.uuid4().hex}" if "://" not in shared else ""
                with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill}) as con:
                    con.register("counts", ds.dataset(files, schema=_COUNTS, filesystem=store, format="parquet"))
                    for out in con.sql("SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(units)::BIGINT AS units FROM counts GROUP BY term").to_arrow_reader(100_000):
                        yield from pa.Table.from_batches([out]).cast(_COUNTS).to_batches()

    tasks = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, len(folders), 1, tasks).mapInArrow(work, "term string, occurrences long, units long")


def count_terms(entries: DataFrame, radix_bits: int | None = None, bucket_rows: int = BUCKET_ROWS, more_bits: int = MORE_BITS) -> DataFrame:
    """(term, occurrences, units) summed over entries of the same columns. Null terms are left out; no rows give none.

    The folders' sizes are the only thing sent to the driver: at most 2^bits of a first split, then 2^more_bits for each
    oversized folder, so their number is bounded by the cores and by the rows divided by bucket_rows.
    """
    spark = entries.sparkSession
    bits = radix_bits or first_bits(spark)
    path, ready = _spill(_combined(entries.filter(F.col("term").isNotNull())), bits), []
    while True:
        level = spark.read.schema("term string, occurrences long, units long, bucket long").parquet(path)
        sizes = {r["bucket"]: r["count"] for r in level.groupBy("bucket").count().toLocalIterator()}
        over = [b for b, n in sizes.items() if n > bucket_rows and bits + more_bits <= LAST_BITS]
        ready += [f"{path}/bucket={b}" for b in sizes if b not in set(over)]
        if not over:
            return _aggregated(spark, ready)
        bits += more_bits
        path = _spill(level.filter(F.col("bucket").isin(over)).drop("bucket"), bits)


def _combined(entries: DataFrame) -> DataFrame:
    """Partial sums per input partition, without an exchange."""
    size = 200_000

    def combine(batches):
        held, rows = [], 0

        def total(parts):
            g = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("occurrences", "sum"), ("units", "sum")])
            return pa.Table.from_arrays([g["term"], g["occurrences_sum"], g["units_sum"]], schema=_COUNTS)

        for batch in batches:
            held.append(pa.Table.from_arrays(batch.columns, schema=_COUNTS))
            rows += batch.num_rows
            if rows > size:
                out = total(held)
                if out.num_rows > size // 2:  # mostly distinct: pass on, the buckets combine
                    yield from out.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = [out], out.num_rows
        if held:
            yield from total(held).to_batches()

    return entries.select("term", "occurrences", "units").mapInArrow(combine, "term string, occurrences long, units long")


def marks(counts: DataFrame, rare_up_to: int, common: "F.Column") -> DataFrame:
    """Adds mark: 'rare' up to so many occurrences, else 'common' where the condition on units holds, else null."""
    return counts.withColumn("mark", F.when(F.col("occurrences") <= rare_up_to, "rare").when(common, "common"))
