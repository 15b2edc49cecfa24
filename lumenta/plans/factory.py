"""Descriptions of indexes: `type[,key=value|key=value...]`, `idmap,<inner>`."""

from __future__ import annotations

from dataclasses import dataclass

from lumenta.functions.quantize import Quantizer
from lumenta.types import MAX_DIM, ClusterParameters

TYPES = ("brutal", "inverted", "seismic", "seismic_sq")


@dataclass(frozen=True)
class Description:
    kind: str
    dim: int
    external_ids: bool = False
    clusters: ClusterParameters | None = None
    quantizer: Quantizer | None = None


def parse(dim: int, description: str | None) -> Description:
    """Parts are trimmed; a parameter without exactly one = is ignored, as is an unknown one.

    Clustered indexes default to lambda 10, beta 5, alpha 0.5; quantised ones to 8 bits
    over 0..1, and any quantizer but 16bit means 8 bits.
    """
    if not 0 <= dim <= MAX_DIM:
        raise ValueError("dimension out of range")
    parts = [x.strip() for x in (description or "").split(",")]
    kind = parts[0]
    if kind == "idmap":
        if len(parts) < 2:
            raise ValueError("idmap needs an inner index")
        inner = parse(dim, ",".join(parts[1:]))
        return Description(inner.kind, inner.dim, True, inner.clusters, inner.quantizer)
    if kind not in TYPES:
        raise ValueError(f"unknown index type {kind!r}")
    given = {}
    for p in (parts[1].split("|") if len(parts) > 1 else []):
        pair = [x.strip() for x in p.split("=")]
        if len(pair) == 2:
            given[pair[0]] = pair[1]
    try:
        clusters = ClusterParameters(int(given.get("lambda", 10)), int(given.get("beta", 5)), float(given.get("alpha", 0.5)))
        quantizer = Quantizer(16 if given.get("quantizer") == "16bit" else 8, float(given.get("vmin", 0)), float(given.get("vmax", 1)))
    except ValueError as e:
        raise ValueError(f"bad parameter in {description!r}") from e
    return Description(kind, dim, False, clusters if kind.startswith("seismic") else None, quantizer if kind == "seismic_sq" else None)
