"""Lazy access to the logical tables bound over one test-data directory."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from acreledger.session import EXPANSION, SORTED, configure, input_listing
from acreledger.testbed.binding import BASE_TABLES, BINDINGS, WORD, with_ctes


class Tables(Mapping):
    """Base tables as temp views, bound tables as SELECTs over them; each is resolved once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")
        size, self.listing = input_listing(spark, self.sf_dir)
        self.spark = configure(spark, SORTED * EXPANSION * size)
        self._frames: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def sql(self, text: str) -> DataFrame:
        """Run a SELECT that may name base tables and bound tables."""
        body = with_ctes(text, BINDINGS)
        for name in dict.fromkeys(WORD.findall(body)):
            if name in BASE_TABLES:
                self.base(name).createOrReplaceTempView(name)
        return self.spark.sql(body)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def __iter__(self) -> Iterator[str]:
        return iter([*BASE_TABLES, *BINDINGS])

    def __len__(self) -> int:
        return len(BASE_TABLES) + len(BINDINGS)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in BASE_TABLES:
            return self.base(name)
        if name not in BINDINGS:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self.sql(f"SELECT * FROM {name}")
        return self._frames[name]
