"""Sources that others can add: coverage, tiles and catalogues as tables, loaded so that one failure harms no other."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

#: Version of the interface that an extension must name.
API_VERSION = 1


@runtime_checkable
class CoverageSource(Protocol):
    """Regions with hours per band: target_id, corners and filters."""

    source_id: str

    def coverage(self, spark: SparkSession) -> DataFrame: ...


@runtime_checkable
class TileSource(Protocol):
    """Ranked tiles (see operators/tiles.py)."""

    source_id: str

    def tiles(self, spark: SparkSession) -> DataFrame: ...


@runtime_checkable
class CatalogueSource(Protocol):
    """Points with a category: name, category, ra_deg, dec_deg."""

    source_id: str

    def objects(self, spark: SparkSession) -> DataFrame: ...


@dataclass
class SourceRegistry:
    """Sources by id; what failed to load is kept beside them with its error."""

    sources: dict[str, object] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def load(self, name: str, make: Callable[[], object], api: int = API_VERSION) -> None:
        """Add a source; the first of two with one id stays."""
        try:
            if api != API_VERSION:
                raise ValueError(f"interface version {api}, not {API_VERSION}")
            source = make()
            if not isinstance(source, CoverageSource | TileSource | CatalogueSource):
                raise TypeError("no known kind of source")
        except Exception as e:
            self.failed[name] = f"{type(e).__name__}: {e}"
            return
        self.sources.setdefault(source.source_id, source)

    def of(self, kind: type) -> list[object]:
        return [s for s in self.sources.values() if isinstance(s, kind)]

    def listing(self, spark: SparkSession) -> DataFrame:
        """source_id, kinds and error of everything that was tried."""
        kinds = lambda s: [k.__name__ for k in (CoverageSource, TileSource, CatalogueSource) if isinstance(s, k)]
        rows: Iterable = [(i, kinds(s), None) for i, s in self.sources.items()] + [(n, [], e) for n, e in self.failed.items()]
        return spark.createDataFrame(rows, "source_id string, kinds array<string>, error string")

    def union(self, spark: SparkSession, kind: type, method: str, columns: list[str]) -> DataFrame | None:
        """All rows of one kind of source, with the source's id."""
        from pyspark.sql import functions as F

        out = None
        for s in self.of(kind):
            df = getattr(s, method)(spark).select(F.lit(s.source_id).alias("source_id"), *columns)
            out = df if out is None else out.unionByName(df)
        return out
