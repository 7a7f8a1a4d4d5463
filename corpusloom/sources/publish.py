"""Publishing tables together: copied in the order of what they refer to, checked, and made current by one file."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PublishError(RuntimeError):
    """A copy differs from its source; what was current stays current."""


def checksum(df: DataFrame) -> tuple[int, int, int]:
    """(rows, sum, sum of other hashes) over all columns by name: equal for equal bags of rows, in any order."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    half = lambda h: F.sum(F.pmod(h, F.lit(1 << 31))).alias("x")
    return tuple(x or 0 for x in df.agg(F.count(F.lit(1)), half(F.xxhash64(row)), half(F.xxhash64(F.lit(7), row))).first())


class Publisher:
    """Versions of a set of tables at `path`; the last file of its log names the current one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.order: list[str] = []

    def _log(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema("number long, version string, tables array<string>").parquet(f"{self.path}/log") if there else None

    def current(self) -> tuple[int, str, list[str]] | None:
        log = self._log()
        last = log.orderBy(F.desc("number")).first() if log is not None else None
        return tuple(last) if last else None

    def publish(self, tables: Mapping[str, DataFrame], refers: Mapping[str, Sequence[str]], version: str | None = None, copy=None) -> str:
        """Copy the tables to a version of their own, those referred to first, and make it current if every copy is whole.

        refers: for a table those it refers to; a circle, or a table that isn't there, is an error. Each copy's rows and
        checksums are read back and held against its source; the first that differs raises PublishError, and readers go on with
        what was current. copy(name, df, path) writes a table, as Parquet unless given.
        """
        unknown = {r for t, rs in refers.items() for r in [t, *rs]} - set(tables)
        if unknown:
            raise PublishError(f"referred to but not published: {', '.join(sorted(unknown))}")
        self.order = [t for t in TopologicalSorter({t: refers.get(t, ()) for t in tables}).static_order()]
        version = version or uuid.uuid4().hex
        copy = copy or (lambda _, df, path: df.write.mode("overwrite").parquet(path))
        for name in self.order:
            at = f"{self.path}/version={version}/{name}"
            copy(name, tables[name], at)
            want, got = checksum(tables[name]), checksum(self.spark.read.schema(tables[name].schema).parquet(at))
            if want != got:
                raise PublishError(f"{name}: {want[0]} rows in the source, {got[0]} in the copy" if want[0] != got[0] else f"{name}: the copy has other values")
        last = self.current()
        entry = [(last[0] + 1 if last else 0, version, self.order)]
        self.spark.createDataFrame(entry, "number long, version string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def read(self) -> dict[str, DataFrame]:
        """The tables of the current version; none before the first."""
        last = self.current()
        return {t: self.spark.read.parquet(f"{self.path}/version={last[1]}/{t}") for t in last[2]} if last else {}
