"""A shop: its tables by name, each a DataFrame that is opened on first use."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tradewind.functions.geomap import geo_map


class Shop(Mapping[str, DataFrame]):
    """Read-only mapping from table name to DataFrame.

    Operators ask only for the tables they need, so a shop may hold any subset
    of the known tables, plus tables of its own.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
    ):
        self.spark = spark
        self._tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def __contains__(self, name: object) -> bool:
        return name in self._tables

    def replace(self, **tables: DataFrame) -> Shop:
        """The same shop with some tables replaced or added."""
        return Shop(self.spark, {**self._tables, **tables})

    def geo_map(self) -> DataFrame:
        """The shop's own department map, else the built-in one."""
        return self["geo_map"] if "geo_map" in self else geo_map(self.spark)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, names: list[str]) -> Shop:
        """One Parquet dataset per table: ``<path>/<name>.parquet``."""
        return cls(spark, {n: partial(spark.read.parquet, f"{path}/{n}.parquet") for n in names})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, prefix: str = "") -> Shop:
        """Every catalog table of a database whose name starts with ``prefix``."""
        names = [t.name for t in spark.catalog.listTables(database) if t.name.startswith(prefix)]
        return cls(
            spark, {n.removeprefix(prefix): partial(spark.table, f"{database}.{n}") for n in names}
        )

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        key_ranges: Mapping[str, tuple[str, int, int]],
        prefix: str = "",
        partitions: int = 64,
        **options: str,
    ) -> Shop:
        """Tables of a live shop database, each read in parallel by key range.

        ``key_ranges`` maps a table name to its numeric key column and that
        key's lowest and highest value; Spark reads one range per partition.
        """

        def reader(name: str) -> DataFrame:
            column, low, high = key_ranges[name]
            return (
                spark.read.format("jdbc")
                .options(url=url, dbtable=prefix + name, **options)
                .option("partitionColumn", column)
                .option("lowerBound", low)
                .option("upperBound", high)
                .option("numPartitions", partitions)
                .load()
            )

        return cls(spark, {n: partial(reader, n) for n in key_ranges})
