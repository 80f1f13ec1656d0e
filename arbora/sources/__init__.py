"""Relations by name: any DataFrame, table, view, or file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Resolves names to DataFrames: those registered first, then the session's tables and views."""

    def __init__(self, spark: SparkSession):
        self.spark, self.frames = spark, {}

    def register(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df
        df.createOrReplaceTempView(name)

    def register_files(self, name: str, path: str, format: str = "parquet", schema: str | None = None, **options) -> None:
        """A file or folder; CSV and JSON want a schema, as inferring one reads the data."""
        reader = self.spark.read.format(format).options(**options)
        self.register(name, (reader.schema(schema) if schema else reader).load(path))

    def resolve(self, name: str) -> DataFrame:
        return self.frames[name] if name in self.frames else self.spark.table(name)
