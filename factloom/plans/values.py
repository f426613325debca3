"""The stored values of tables, kept as long as the files of the tables stay the same."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from factloom.operators.profile import reference_columns, vocabulary_columns
from factloom.operators.resolution import catalogue_of, references_of
from factloom.session import settled


class ValueCache:
    """Catalogues of values and references of tables (name -> folder or file of Parquet), each worked out once for each state of its files.

    Every use looks at the files first (path, length and time of each): a table of which any file was written, added or
    removed is read again, the others aren't.  The catalogues lie in the shared folder.
    """

    def __init__(self, spark: SparkSession, folders: Mapping[str, str], bound: int | None = None):
        self.spark, self.folders, self.bound = spark, dict(folders), bound
        self._held: dict[str, tuple[str, DataFrame | None, DataFrame | None]] = {}
        #: Tables that the last use read again.
        self.refreshed: list[str] = []

    def generation(self, name: str) -> str:
        """A digest of the files of a table."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders[name])
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(place, True)
        seen = []
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()

    def invalidate(self, name: str | None = None) -> None:
        """Forget one table, or all."""
        self._held = {} if name is None else {n: h for n, h in self._held.items() if n != name}

    def _refresh(self, names: Iterable[str]) -> None:
        self.refreshed = []
        for name in names:
            now = self.generation(name)
            if name in self._held and self._held[name][0] == now:
                continue
            df = self.spark.read.parquet(self.folders[name])
            values = settled(catalogue_of({name: df}, self.bound)) if vocabulary_columns(df) else None
            references = settled(references_of({name: df})) if reference_columns(df) else None
            self._held[name] = (now, values, references)
            self.refreshed.append(name)

    def _all(self, at: int, names: Iterable[str] | None, schema: str) -> DataFrame:
        names = list(self.folders if names is None else names)
        self._refresh(names)
        out = self.spark.createDataFrame([], schema)
        for name in names:
            if (df := self._held[name][at]) is not None:
                out = out.unionByName(df.select(*out.columns))
        return out

    def catalogue(self, names: Iterable[str] | None = None) -> DataFrame:
        """table_name, column_name, value, match_kind, stored of some tables, or all."""
        return self._all(1, names, "table_name string, column_name string, value string, match_kind string, stored string")

    def references(self, names: Iterable[str] | None = None) -> DataFrame:
        """table_name, column_name, value of some tables, or all."""
        return self._all(2, names, "table_name string, column_name string, value string")
