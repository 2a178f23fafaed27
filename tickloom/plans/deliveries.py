"""A table that comes in several deliveries, for the queries that run streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.versions import Files


class Deliveries:
    """df in numbered deliveries: all are written at once, each comes to light when it is asked for.

    number: which delivery a row belongs to, from 0 on. The stream reads `path`, whose files appear with `come`.
    """

    def __init__(self, spark: SparkSession, df: DataFrame, number: Column, at: str):
        self.files, self.at, self.path, self.schema = Files(spark, at), at, f"{at}/come", df.schema
        df.withColumn("delivery", number.cast("int")).write.partitionBy("delivery").parquet(f"{at}/all")
        self.files.fs.mkdirs(self.files.at(self.path))

    def come(self, k: int) -> None:
        name = f"delivery={k}"
        if self.files.exists(f"{self.at}/all/{name}"):
            self.files.fs.rename(self.files.at(f"{self.at}/all/{name}"), self.files.at(f"{self.path}/{name}"))

    def gone(self, k: int) -> None:
        """What has been worked off is taken away, as a topic's retention does; a stream doesn't read it again."""
        self.files.delete(f"{self.path}/delivery={k}")

    def stream(self, session: SparkSession) -> DataFrame:
        return session.readStream.schema(self.schema).parquet(self.path).select(*self.schema.names)


def evenly(df: DataFrame, order: str, n: int) -> Column:
    """The number of the n equal spans of `order` in which a row lies."""
    first, last = df.agg(F.min(order), F.max(order)).first()
    if first is None:
        return F.lit(0)
    return F.least(F.expr(f"({order} - {first}L) div {-(-(last - first + 1) // n)}L"), F.lit(n - 1).cast("long"))


#: The same in SQL, over a table with the order's column.
EVENLY = "({order} - (SELECT min({order}) FROM {table})) // (((SELECT max({order}) - min({order}) + 1 FROM {table}) + {n} - 1) // {n})"
