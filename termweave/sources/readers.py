"""Readers: bibliographic files through a Python data source, thesaurus, map and network files through Spark's readers."""

from __future__ import annotations

import io
import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from termweave.sources import formats

_COLUMNS = "title pub_year source doi authors keywords keywords_plus abstract citations cited_refs raw".split()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or of any URI that Arrow knows, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _File(InputPartition):
    def __init__(self, ordinal: int, path: str):
        self.ordinal, self.path = ordinal, path


class _BibReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        files = []
        for p in self.options["path"].split("\n"):
            store, path = _store(p)
            info = store.get_file_info(path)
            if info.type == fs.FileType.Directory:
                found = store.get_file_info(fs.FileSelector(path))
                root = p.rstrip("/")
                files += [f"{root}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
            else:
                files.append(p)
        return [_File(i, p) for i, p in enumerate(files)]

    def read(self, partition: _File):
        name = os.path.basename(partition.path)
        wanted, strict = self.options.get("bibformat"), self.options.get("strict", "false").lower() == "true"
        store, path = _store(partition.path)
        with store.open_input_stream(path, compression=None) as f:
            data = f.read()
        if formats.sniff("", name) == "excel":
            found, records = "excel", formats.read_excel(io.BytesIO(data))
        elif wanted == "articles_xml":
            found, records = wanted, formats.articles_from_xml(formats.decode(data), self.options.get("terms", "both"))
        else:
            found, records = formats.parse(data, name, wanted, strict)
        for i, r in enumerate(records):
            yield ((partition.ordinal << 32) + i, name, found, *[r[c] for c in _COLUMNS])


class BibSource(DataSource):
    """spark.read.format("bib"): one partition per file, records in file order. Options: bibformat, strict, terms."""

    @classmethod
    def name(cls) -> str:
        return "bib"

    def schema(self) -> str:
        return formats.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BibReader(dict(self.options))


def read_bib(spark: SparkSession, paths: str | list[str], format: str | None = None, strict: bool = False, terms: str = "both") -> DataFrame:
    """Records of bibliographic files, in the order of paths and of the records in them; nothing is joined or left out."""
    spark.dataSource.register(BibSource)
    reader = spark.read.format("bib").option("strict", str(strict)).option("terms", terms)
    if format:
        reader = reader.option("bibformat", format)
    return reader.load("\n".join([paths] if isinstance(paths, str) else paths))


def parse_texts(df: DataFrame, key: str, text: str, format: str) -> DataFrame:
    """(key, ordinal, and the canonical columns) of exports that are held as texts in a column; null texts have no records."""
    kind = df.schema[key].dataType.simpleString()
    columns = formats.SCHEMA.split(", ", 3)[3]

    def work(batches):
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = formats.parse(value.encode(), format=format)[1] if value else []
                rows += [{key: k, "ordinal": i, **r, "raw": list(r["raw"].items())} for i, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = f"`{key}` {kind}, ordinal bigint, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.select(key, text).mapInArrow(work, ddl)


def notes(records: DataFrame) -> DataFrame:
    """(src_file, src_format, records): one row per file."""
    return records.groupBy("src_file", "src_format").agg(F.count("*").alias("records"))


def _no_mark(col):
    return F.regexp_replace(col, "^﻿", "")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, cells) of a file of tab-separated values; such files are small, each is read by one task."""
    whole = spark.read.text(path, wholetext=True).select(_no_mark(F.col("value")).alias("value"))
    return whole.select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line")).filter(F.trim("line") != "").select("line_no", F.split("line", "\t").alias("cells"))


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """(label, replace_by, seq) of a thesaurus file with a header; rows with one cell or a blank label are skipped."""
    rows = _lines(spark, path).filter("line_no > 0 AND size(cells) >= 2")
    return rows.select(F.trim(F.col("cells")[0]).alias("label"), F.trim(F.col("cells")[1]).alias("replace_by"), F.col("line_no").cast("bigint").alias("seq")).filter("label <> ''")


def resolve_preset(name: str, folder: str) -> str:
    """Path of a preset: the name itself, name.txt or thesaurus_name.txt in the folder."""
    for path in (name, os.path.join(folder, name), os.path.join(folder, f"{name}.txt"), os.path.join(folder, f"thesaurus_{name}.txt")):
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"no preset {name} in {folder}")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, x, y, cluster, occurrences, total_link_strength, avg_year, avg_citations) of a map file.

    Columns are found by the header; bad numbers are 0, a bad cluster 1; rows whose id is missing or no number get ids after
    the largest one, in file order.
    """
    first = spark.read.text(path).select(_no_mark(F.col("value")).alias("v")).first()
    names = [c.strip().lower() for c in first["v"].split("\t")] if first else []
    at = lambda test: next((i for i, n in enumerate(names) if test(n)), None)
    cell = lambda i: F.trim(F.coalesce(F.get(F.col("cells"), F.lit(i)), F.lit(""))) if i is not None else F.lit("")
    number = lambda i, otherwise=0.0: F.coalesce(cell(i).try_cast("double"), F.lit(otherwise))
    rows = _lines(spark, path).filter("line_no > 0")
    table = rows.select(
        "line_no", cell(at(lambda n: n == "id")).try_cast("bigint").alias("given"), cell(at(lambda n: n == "label")).alias("label"), cell(at(lambda n: n == "id")).alias("raw_id"),
        number(at(lambda n: n == "x")).alias("x"), number(at(lambda n: n == "y")).alias("y"), number(at(lambda n: n == "cluster"), 1.0).cast("int").alias("cluster"),
        number(at(lambda n: n.startswith("weight<") and "total link" not in n)).cast("bigint").alias("occurrences"), number(at(lambda n: n.startswith("weight<") and "total link" in n)).alias("total_link_strength"),
        number(at(lambda n: n.startswith("score<") and "year" in n)).alias("avg_year"), number(at(lambda n: n.startswith("score<") and "cit" in n and "year" not in n)).alias("avg_citations"),
    ).filter("label <> '' OR raw_id <> ''")
    most = F.max(F.coalesce("given", F.lit(0))).over(Window.partitionBy())
    spare = F.sum(F.when(F.col("given").isNull(), 1).otherwise(0)).over(Window.orderBy("line_no"))
    return table.select(F.coalesce("given", most + spare).alias("id"), F.when(F.col("label") == "", F.col("raw_id")).otherwise(F.col("label")).alias("label"), "x", "y", "cluster", "occurrences", "total_link_strength", "avg_year", "avg_citations")


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of a network file without header: ends in rising order, repeated edges summed, bad rows skipped."""
    return network_of_lines(spark.read.text(path))


def network_of_lines(lines: DataFrame) -> DataFrame:
    """read_network of a table with a column value, one line a row."""
    cells = F.split(_no_mark(F.col("value")), "\t")
    rows = lines.select(cells.alias("c")).filter(F.size("c") >= 2)
    strength = F.trim(F.coalesce(F.get("c", F.lit(2)), F.lit("")))
    parsed = rows.select(F.trim(F.col("c")[0]).try_cast("bigint").alias("a"), F.trim(F.col("c")[1]).try_cast("bigint").alias("b"), F.when(strength == "", 1.0).otherwise(strength.try_cast("double")).alias("w"))
    return parsed.filter("a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("weight"))
