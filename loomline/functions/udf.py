"""Named batch functions: Arrow batches in, Arrow batches out.

The first function registered under a name stays. Filters belong before a function, as none is pushed through it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomline.errors import FunctionError
from loomline.session import ship

Batches = Iterator[pa.RecordBatch]


class Registry:
    def __init__(self) -> None:
        self._held: dict[str, Callable[[Batches], Batches]] = {}

    def __len__(self) -> int:
        return len(self._held)

    def register(self, name: str, function: Callable[[Batches], Batches]) -> None:
        if not callable(function):
            raise FunctionError(f"{name} is no function")
        self._held.setdefault(name, function)

    def apply(self, name: str, df: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
        if name not in self._held:
            raise FunctionError(f"Module not found: {name}")
        ship(df.sparkSession)
        return df.mapInArrow(self._held[name], schema or df.schema)


def identity(batches: Batches) -> Batches:
    yield from batches


def scaled(column: str, factor: float) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            at = b.schema.get_field_index(column)
            yield b.set_column(at, b.schema.field(at), pc.multiply(b.column(at), factor))

    return run
