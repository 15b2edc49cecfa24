"""Min-max linear quantisation to 8 or 16 bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Quantizer:
    bits: int = 8
    vmin: float = 0.0
    vmax: float = 1.0

    def __post_init__(self) -> None:
        if self.bits not in (8, 16):
            raise ValueError("bits must be 8 or 16")
        if self.vmax <= self.vmin:
            raise ValueError("vmax must be above vmin")

    @property
    def top(self) -> int:
        """The largest code."""
        return (1 << self.bits) - 1

    @property
    def bytes_per_value(self) -> int:
        return self.bits // 8

    def encode(self, value: Column) -> Column:
        """The nearest code, halves away from zero; values outside the range get the nearest end's."""
        scaled = (value.cast("double") - F.lit(float(self.vmin))) * F.lit(float(self.top)) / F.lit(float(self.vmax - self.vmin))
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(self.top)), scaled))).cast("bigint")

    def decode(self, code: Column) -> Column:
        return F.lit(float(self.vmin)) + code.cast("double") * F.lit(float(self.vmax - self.vmin)) / F.lit(float(self.top))

    def decode_dot(self, total: Column, query: Quantizer) -> Column:
        """The inner product that an integer one of codes stands for; exact only where both ranges start at 0."""
        factor = (self.vmax - self.vmin) * (query.vmax - query.vmin)
        return total.cast("double") * F.lit(float(factor)) / F.lit(float(self.top) * float(query.top))
