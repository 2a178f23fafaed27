"""Rebuilding tables from a log beside those that are read, and one swap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from .versions import Files, Versions


class Generations:
    """Complete sets of tables, of which readers see the newest that has been finished.

    A generation has tables and a checkpoint of its own, so a rebuild starts from the log's first offset and meets none of the old
    state: neither guard can reject what is replayed. Both outputs change by the one file that names the new generation.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]]):
        self.spark, self.path, self.keys, self.files = spark, path, keys, Files(spark, path)

    def number(self) -> int:
        """Of the generation that is read; -1 before the first."""
        return max((int(n) for n in self.files.names(f"{self.path}/finished") if n.isdigit()), default=-1)

    def tables(self, number: int | None = None) -> Versions:
        return Versions(self.spark, f"{self.path}/generation-{self.number() if number is None else number}", self.keys)

    def checkpoint(self, number: int) -> str:
        return f"{self.path}/generation-{number}/checkpoint"

    def rebuild(self, run: Callable[[Versions, str], None]) -> int:
        """run(tables, checkpoint) fills the next generation; when it returns, readers see it. If it fails, they go on as before.

        A rebuild that has failed is taken up where it stopped, by its own checkpoint.
        """
        number = self.number() + 1
        run(self.tables(number), self.checkpoint(number))
        if not self.files.appear(f"{self.path}/finished/{number:012d}", ""):
            raise RuntimeError("another rebuild has finished meanwhile")
        return number

    def drop_before(self, number: int) -> None:
        """Delete older generations, when no reader is left in them."""
        for name in self.files.names(self.path):
            kind, _, n = name.rpartition("-")
            if kind == "generation" and n.isdigit() and int(n) < number:
                self.files.delete(f"{self.path}/{name}")
