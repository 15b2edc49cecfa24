"""Parameters and their checks."""

from __future__ import annotations

from dataclasses import dataclass

#: Terms are numbered below this.
MAX_DIM = 65_536
#: Fills result rows up to k.
PAD_SCORE, PAD_ID = -1.0, -1


@dataclass(frozen=True)
class ClusterParameters:
    """lam: postings kept of each term (0 or less: all, -1: by the corpus size); beta: clusters of a term (0: the
    root of its length, -1: a tenth of lam); alpha: part of a summary's mass that is kept."""

    lam: int = -1
    beta: int = -1
    alpha: float = 0.4

    def __post_init__(self) -> None:
        if self.beta < -1:
            raise ValueError("beta must be -1 or more")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be in 0..1")

    def resolved(self, n: int) -> ClusterParameters:
        """With -1 replaced by what a corpus of n vectors calls for."""
        lam = max(int(0.0005 * n), 160) if self.lam == -1 else self.lam
        return ClusterParameters(lam, int(0.1 * lam) if self.beta == -1 else self.beta, self.alpha)


@dataclass(frozen=True)
class SearchParameters:
    """cut: heaviest query terms that choose candidates; heap_factor: above 1 looks at more clusters; mode: exhaustive, setwise or
    sequential; prune: an inverted index skips terms that cannot matter, which needs weights of 0 or more."""

    cut: int = 10
    heap_factor: float = 1.0
    mode: str = "setwise"
    vmin: float | None = None
    vmax: float | None = None
    prune: bool = False

    def __post_init__(self) -> None:
        if self.cut <= 0:
            raise ValueError("cut must be positive")
        if not self.heap_factor >= 0:
            raise ValueError("heap_factor must be 0 or more")
        if self.mode not in ("exhaustive", "setwise", "sequential"):
            raise ValueError(f"unknown mode {self.mode}")


def check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")
