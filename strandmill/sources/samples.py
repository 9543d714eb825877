"""Sample-table scans with a deterministic flat order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.operators.registry import DeclaredSchema
from strandmill.operators.fit import bounded_join


def scan(spark: SparkSession, path: str, schema: DeclaredSchema | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """All Parquet files under a path with ``file_path`` and ``row_in_file``.

    With a declared schema the columns are read as declared and absent static ones become null.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    df = reader.parquet(path)
    if schema is not None:
        declared = {f.name: f.dataType for f in schema.struct()}
        df = df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_in_file"))
        present = [c for c in df.columns if c in declared]
        extra = [c for c in df.columns if c not in declared]
        return schema.conform(df.select(*[F.col(c).cast(declared[c]) for c in present], *extra))
    wanted = [F.col(c) for c in columns] or ["*"]
    return df.select(*wanted, F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.row_index").alias("row_in_file"))


def file_offsets(scanned: DataFrame) -> DataFrame:
    """First flat index of each file, files in name order; one row per file."""
    sizes = scanned.groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy().orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("file_offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def with_flat_index(scanned: DataFrame) -> DataFrame:
    """Add ``flat_idx``: position in (file name, row) order."""
    offsets = file_offsets(scanned).select("file_path", "file_offset")
    return bounded_join(scanned, offsets, ["file_path"], "inner").withColumn(
        "flat_idx", F.col("file_offset") + F.col("row_in_file")).drop("file_offset")


def lookup_rows(scanned: DataFrame, wanted: DataFrame, index: str = "flat_idx") -> DataFrame:
    """Rows at the wanted flat indices (an equi-join; Spark broadcasts a small batch itself)."""
    return with_flat_index(scanned).join(wanted.select(F.col(index).alias("flat_idx")), "flat_idx")


def locate(scanned: DataFrame, wanted: DataFrame, index: str = "flat_idx") -> DataFrame:
    """(flat index -> file, row in file)."""
    return lookup_rows(scanned.select("file_path", "row_in_file"), wanted, index).select(
        "flat_idx", "file_path", "row_in_file")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per file: rows and bytes on disk."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return df.groupBy(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count(F.lit(1)).alias("rows"))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """Per file: rows, row groups and compressed bytes, from the Parquet footers read in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(path).select("path")

    def footers(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch.column("path").to_pylist():
                filesystem, inner = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                meta = pq.read_metadata(inner, filesystem=filesystem)
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                size = sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns))
                out.append((uri, meta.num_rows, meta.num_row_groups, size))
            yield pa.RecordBatch.from_pydict({
                "file_path": [o[0] for o in out], "rows": [o[1] for o in out],
                "row_groups": [o[2] for o in out], "bytes": [o[3] for o in out]})

    return files.mapInArrow(footers, "file_path string, rows long, row_groups long, bytes long")


def fit_scan(df: DataFrame, columns: Sequence[Sequence[str]], is_train: str = "is_train") -> DataFrame:
    """The one pruned projection all fits share: union of their columns, training rows only."""
    union = list(dict.fromkeys(c for cols in columns for c in cols))
    return df.where(F.col(is_train)).select(*union)
