"""What a panel is: one row for each (entity, ordered step), with sensors and an operating regime."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import types as T

RUL_CAP = 125
END_OF_LIFE = 5
SAFETY_FACTOR = 0.88

RAW_NAMES = ["engine_id", "cycle", "op1", "op2", "op3", *[f"s{k}" for k in range(1, 22)]]
RAW_SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n in ("engine_id", "cycle") else T.DoubleType()) for n in RAW_NAMES])


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "entity_id"
    step: str = "step"
    sensors: tuple[str, ...] = ("s1", "s2", "s3", "s4")
    regime: str = "regime"
    rul: str = "rul"
    cap: int = RUL_CAP

    def ordered(self, rows: int | None = None, ahead: int = 0):
        """The window over an entity's steps in order, or its frame of the last `rows` rows."""
        w = Window.partitionBy(self.entity).orderBy(self.step)
        return w if rows is None else w.rowsBetween(-(rows - 1), ahead)

    def whole(self):
        return Window.partitionBy(self.entity)


RAW = PanelSpec("engine_id", "cycle", tuple(f"s{k}" for k in range(1, 22)), "op_cluster")
