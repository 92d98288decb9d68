"""Models by name: resolved in order of their references, kept as views or written as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quern.functions.scalar import checked_identifier
from quern.storage import SnapshotTable

from .pipelines import in_order

VIEW, TABLE = "view", "table"


@dataclass(frozen=True)
class Model:
    """build gets a function from a name to the frame of a model or source."""

    name: str
    build: Callable[[Callable[[str], DataFrame]], DataFrame]
    refs: tuple[str, ...] = ()
    kind: str = VIEW
    schema: str = "marts"

    def __post_init__(self) -> None:
        checked_identifier(self.name)
        checked_identifier(self.schema)
        if self.kind not in (VIEW, TABLE):
            raise ValueError(f"{self.name}: {self.kind!r} is neither a view nor a table")


class Registry:
    """sources: from a name to a source frame; names that no model has are looked up there."""

    def __init__(self, spark: SparkSession, sources: Callable[[str], DataFrame], target: str) -> None:
        self.spark, self.sources, self.target = spark, sources, target.rstrip("/")
        self.models: dict[str, Model] = {}
        self.built: dict[str, DataFrame] = {}

    def add(self, model: Model) -> Registry:
        if model.name in self.models:
            raise ValueError(f"two models named {model.name}")
        self.models[model.name] = model
        return self

    def ref(self, name: str) -> DataFrame:
        if name in self.models:
            if name not in self.built:
                raise ValueError(f"{name} is used before it is built; name it among the references")
            return self.built[name]
        return self.sources(name)

    def materialised(self, model: Model) -> DataFrame:
        """A view is named in the session; a table is written below `target/schema` and becomes current when it is whole."""
        df = model.build(self.ref)
        if model.kind == TABLE:
            table = SnapshotTable(self.spark, f"{self.target}/{model.schema}/{model.name}")
            table.overwrite(df)
            df = table.read()
        df.createOrReplaceTempView(model.name)
        self.built[model.name] = df
        return df

    def build(self) -> dict[str, DataFrame]:
        """All models, each after those that it refers to."""
        if unknown := sorted({r for m in self.models.values() for r in m.refs} - self.models.keys()):
            raise ValueError(f"references to models that there aren't: {unknown}")
        return in_order({m.name: (m.refs, lambda _, m=m: self.materialised(m)) for m in self.models.values()})
