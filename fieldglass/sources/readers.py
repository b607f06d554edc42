"""Readers of the file kinds in use."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldglass.operators.clean import keep_first


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; quoted fields may hold doubled quotes, and line ends if multi_line."""
    return spark.read.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path, header=True, schema=schema, multiLine=multi_line, escape='"')


def read_csv_zip(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV members of zip files, a task a file; a zip can't be split, so large inputs belong in gzip parts or Parquet."""
    return unzipped(spark.read.format("binaryFile").load(path).select("content"), schema)


def unzipped(files: DataFrame, schema: StructType) -> DataFrame:
    """The rows of the CSV members of zip files held in `content`."""
    names = schema.fieldNames()

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.schema([(n, pa.string()) for n in names])
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(archive.namelist()):
                        rows, lines = [], csv.DictReader(io.TextIOWrapper(archive.open(member), "utf-8", newline=""))
                        for row in lines:
                            rows.append({n: row.get(n) or None for n in names})
                            if len(rows) == 5000:
                                yield pa.RecordBatch.from_pylist(rows, text)
                                rows = []
                        yield pa.RecordBatch.from_pylist(rows, text)

    rows = files.mapInArrow(unzip, ", ".join(f"`{n}` string" for n in names))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


class Member(InputPartition):
    """A CSV file within a zip file."""

    def __init__(self, path: str, name: str) -> None:
        self.path, self.name = path, name


class ZippedCsv(DataSource):
    """spark.read.format("zipped_csv").schema(...).load(path): the CSV members of a zip file, or of all zip files in a folder, a partition a member.

    Columns of the schema are found by the header of each member, so a schema of few columns parses those only; one that a member lacks is null, and so
    are empty fields and ones that don't fit their type. Paths are what pyarrow reads (local, hdfs, s3, gs); members that aren't .csv are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ZippedReader(schema, self.options["path"])


class _ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str) -> None:
        self.schema, self.path = schema, path

    def partitions(self) -> list[Member]:
        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        out = []
        for info in sorted((i for i in found if i.type == fs.FileType.File and i.path.endswith(".zip")), key=lambda i: i.path):
            with files.open_input_file(info.path) as source, zipfile.ZipFile(source) as archive:  # reads the list at its end only
                out += [Member(info.path, name) for name in sorted(archive.namelist()) if name.endswith(".csv")]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        target = to_arrow_schema(self.schema)
        with files.open_input_file(partition.path) as source, zipfile.ZipFile(source) as archive, archive.open(partition.name) as member:
            rows = csv.DictReader(io.TextIOWrapper(member, "utf-8", newline=""))
            while block := list(itertools.islice(rows, 5000)):
                yield pa.RecordBatch.from_arrays([fitted([r.get(f.name) or None for r in block], f.type) for f in target], schema=target)


def fitted(values: list[str | None], kind: pa.DataType) -> pa.Array:
    """Texts as the type; null where one doesn't fit."""
    try:
        return pa.array(values, pa.string()).cast(kind)
    except pa.ArrowInvalid:
        out = []
        for v in values:
            try:
                out.append(pa.array([v], pa.string()).cast(kind)[0].as_py())
            except pa.ArrowInvalid:
                out.append(None)
        return pa.array(out, kind)


def read_zipped_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    spark.dataSource.register(ZippedCsv)
    return spark.read.format("zipped_csv").schema(schema).load(path)


def read_waves(waves: Mapping[int, DataFrame], column: str = "Year") -> DataFrame:
    """One table from one a wave; columns that a wave lacks are null."""
    out = None
    for year, df in waves.items():
        one = df.withColumn(column, F.lit(year))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_filtered(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Rows with a value in `name`, the first of each value."""
    return keep_first(df.where(F.col(name).isNotNull()), [name], order)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """class xc yc w h from text lines; lines that don't parse give nulls."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ("xc", "yc", "w", "h")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("int").alias("class"), *[F.get(parts, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names, 1)])


def files_by_class(df: DataFrame, path: str, classes: Mapping[str, int]) -> DataFrame:
    """The class whose pattern the path matches first, else null."""
    out = None
    for pattern, label in classes.items():
        hit = F.col(path).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return df.withColumn("class", out)


ANNOTATIONS = "filename string, width int, height int, class string, xmin int, ymin int, xmax int, ymax int"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ANNOTATIONS)
