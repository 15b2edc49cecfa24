"""Best-fit packing of token pieces into sequences, by linear grouping.

Everything that is optimised is the histogram of piece lengths, which has at most as
many entries as a sequence has tokens, however large the corpus. Large lengths are
split into groups of equally many pieces, each rounded up to its longest; fillings of
a sequence are chosen for the few rounded sizes and repeated; then the actual pieces
take the places of the rounded ones, which shows the true gaps; small pieces go,
longest first, into the smallest gap that holds them. The result is a short list of
runs: so many equal sequences, with the lengths that they hold. Pieces get their
places in parallel, by their number among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenta.llm import tokens
from lumenta.llm.common import stored

CAPACITY = 1024
GROUPS = 256
#: How far from the linear programme's optimum its solution may be.
GAP = 0.001
#: A guard against endless exchanges of equal fillings: rounds of new fillings; pieces that the best solution till then leaves are filled in greedily.
ROUNDS = 1000
#: Pieces of each length are numbered within buckets, one for every so many pieces of all, at least and at most so many.
ROWS, SALTS = 1_000_000, (64, 1024)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, after a first that may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's pieces; null texts count as empty."""
    path = vocabulary or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                doc = doc.as_py()
                out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Rounded sizes, longest first, each with the [length, count] that it stands for."""
    total, out, seen, share = sum(counts.values()), [], 0, -1
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            g = seen * groups // total
            if g != share and (not out or out[-1][0] != length):
                out.append((length, []))
            share = g
            n = min(left, -(-(g + 1) * total // groups) - seen)
            held = out[-1][1]
            if held and held[-1][0] == length:
                held[-1][1] += n
            else:
                held.append([length, n])
            seen, left = seen + n, left - n
    return out


def filling(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Sizes' indices for one sequence: the largest, then the best one, two or three for what is free, repeated."""
    order = [i for i in range(len(sizes)) if left[i]]
    chosen = [order[0]]
    used = Counter(chosen)
    gap = capacity - sizes[order[0]]
    while True:
        free = sorted((sizes[i], i) for i in order if sizes[i] <= gap and left[i] > used[i])
        if not free:
            return chosen
        values = [s for s, _ in free]

        def under(most: int, taken: Counter) -> int | None:
            k = bisect.bisect_right(values, most) - 1
            while k >= 0 and left[free[k][1]] - used[free[k][1]] <= taken[k]:
                k -= 1
            return k if k >= 0 else None

        best, how = values[-1], [len(free) - 1]
        for a in range(len(free) - 1, -1, -1):
            if best == gap:
                break
            b = under(gap - values[a], Counter([a]))
            if b is not None and values[a] + values[b] > best:
                best, how = values[a] + values[b], [a, b]
        if best < gap and values[0] * 3 <= gap:
            for a in range(len(free) - 1, -1, -max(1, len(free) // 24)):
                for b in range(a, -1, -max(1, len(free) // 24)):
                    if a == b and left[free[a][1]] - used[free[a][1]] < 2:
                        continue
                    c = under(gap - values[a] - values[b], Counter([a, b])) if gap > values[a] + values[b] else None
                    if c is not None and values[a] + values[b] + values[c] > best:
                        best, how = values[a] + values[b] + values[c], [a, b, c]
                if best == gap:
                    break
        for k in how:
            chosen.append(free[k][1])
            used[free[k][1]] += 1
        gap -= best


def fillings(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, list[Counter]]:
    """The value of the most valuable filling of one sequence, and for each size the best one that holds it; sizes ascend."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for w in range(int(sizes[0]), capacity + 1):
        worth = best[w - sizes[: fits[w]]] + values[: fits[w]]
        i = int(worth.argmax())
        best[w] = best[w - 1]
        if worth[i] > best[w]:
            best[w], last[w] = worth[i], i
    size, of = sizes.tolist(), last.tolist()
    out = []
    for i in np.argsort(-(values + best[capacity - sizes])).tolist():
        taken, w = Counter([i]), capacity - size[i]
        while w >= size[0]:
            if of[w] < 0:
                w -= 1
                continue
            taken[of[w]] += 1
            w -= size[of[w]]
        out.append(taken)
    return float(best[-1]), out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Fillings and how often to use each: the linear programme over all fillings, rounded down; sizes descend.

    Fillings are found as those that the current dual values make worth more than a
    sequence (column generation), the best for each size at a time. If the best is worth
    v, the optimum is at least the v-th part of what is reached, so it ends when v is at
    most 1 + GAP. Vectors are multiplied element by element: a threaded matrix library
    beside the JVM would stall the driver.
    """
    s, d = np.array(sizes[::-1]), np.array(demand[::-1], float)
    basis = np.diag(capacity // s)
    inverse = np.diag(1 / np.diag(basis).astype(float))
    x = d / np.diag(basis)
    for _ in range(ROUNDS if sizes else 0):
        value, found = fillings(s, inverse.sum(axis=0), capacity)
        if value <= 1 + GAP:
            break
        for taken in found:
            own, times = np.fromiter(taken.keys(), int), np.fromiter(taken.values(), int)
            if (inverse[:, own].sum(axis=0) * times).sum() <= 1 + GAP / 2:
                continue
            direction = (inverse[:, own] * times).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(direction > 1e-9, x / direction, np.inf)
            out = int(np.argmin(ratio))
            x = np.maximum(x - ratio[out] * direction, 0)
            x[out] = ratio[out]
            basis[:, out] = 0
            basis[own, out] = times
            pivot = inverse[out] / direction[out]
            inverse -= direction[:, None] * pivot
            inverse[out] = pivot
    n = len(sizes)
    return [([n - 1 - i for i in range(n - 1, -1, -1) for _ in range(basis[i, k])], int(times)) for k, times in enumerate(np.floor(x + 1e-9)) if times >= 1]


class Run:
    """count equal sequences; slots: (length, number of the first piece used), in order of place."""

    __slots__ = ("count", "gap", "slots")

    def __init__(self, count: int, gap: int, slots: list[tuple[int, int]]) -> None:
        self.count, self.gap, self.slots = count, gap, slots

    def split(self, n: int) -> Run:
        """Takes the first n sequences off."""
        rest = Run(self.count - n, self.gap, [(length, first + n) for length, first in self.slots])
        self.count = n
        return rest


def arrange(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> list[Run]:
    """Runs that hold every piece of the histogram {length: count} once."""
    small = capacity // 8 if small is None else small
    counts = {k: n for k, n in counts.items() if n}
    sizes = grouped({k: n for k, n in counts.items() if k > small}, groups)
    held = [[list(x) for x in members] for _, members in sizes]
    left = [sum(n for _, n in m) for m in held]
    rounded = [s for s, _ in sizes]
    used: Counter = Counter()
    runs: list[Run] = []
    planned = configurations(rounded, left, capacity)
    while any(left):
        pattern, times = planned.pop() if planned else (filling(rounded, left, capacity), sum(left))
        need = Counter(pattern)
        times = min(times, *(left[i] // n for i, n in need.items()))
        for i, n in need.items():
            left[i] -= times * n
        while times:  # substitution: as many sequences as all places can take from one actual length each
            step = times
            for i, n in need.items():
                step = min(step, max(1, held[i][0][1] // n))
            slots = []
            for i in pattern:
                parts, take = [], step
                while take:
                    length, n = held[i][0]
                    k = min(n, take)
                    parts.append((length, used[length], k))
                    used[length] += k
                    take -= k
                    held[i][0][1] -= k
                    if not held[i][0][1]:
                        held[i].pop(0)
                slots.append(parts)
            edges = sorted({0, step} | {e for parts in slots for e in np.cumsum([k for *_, k in parts]).tolist()})
            for lo, hi in zip(edges, edges[1:], strict=False):
                row = []
                for parts in slots:
                    at = 0
                    for length, first, k in parts:
                        if at <= lo < at + k:
                            row.append((length, first + lo - at))
                        at += k
                runs.append(Run(hi - lo, capacity - sum(s for s, _ in row), row))
            times -= step
    by_gap: dict[int, list[Run]] = {}
    for r in runs:
        by_gap.setdefault(r.gap, []).append(r)
    gaps = sorted(by_gap)
    for length in sorted((k for k in counts if k <= small), reverse=True):
        todo = counts[length]
        while todo:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                by_gap[capacity] = [Run(-(-todo * length // capacity), capacity, [])]
                gaps.append(capacity)
                continue
            r = by_gap[gaps[k]].pop()
            if not by_gap[gaps[k]]:
                del by_gap[gaps.pop(k)]
            if r.count > todo:
                rest = r.split(todo)
                if rest.gap not in by_gap:
                    bisect.insort(gaps, rest.gap)
                by_gap.setdefault(rest.gap, []).append(rest)
            r.slots.append((length, used[length]))
            used[length] += r.count
            todo -= r.count
            r.gap -= length
            if r.gap not in by_gap:
                bisect.insort(gaps, r.gap)
            by_gap.setdefault(r.gap, []).append(r)
    return [r for rs in by_gap.values() for r in rs if r.slots]


def places(runs: list[Run]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first piece numbers in order, and the sequence and offset of each."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for r in runs:
        at = 0
        for length, first in r.slots:
            rows.setdefault(length, []).append((first, base, at))
            at += length
        base += r.count
    return {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for k, v in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 2, groups: int = GROUPS) -> DataFrame:
    """Every piece of docs with its sequence_id and offset.

    Null and empty texts are one piece, the end id. Repeated rows are packed as often as
    they come, null ids too; extra columns are dropped; an empty table gives an empty one.
    Full pieces are sequences of their own, with negative ids.
    """
    table = stored(pieces(docs, capacity, vocabulary, end_id), "pieces")
    salts = min(max(SALTS[0], table.count() // ROWS), SALTS[1])
    # salted by all columns, so that rows with null ids are spread too
    salted = table.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    # at most capacity * salts counts
    seen = np.zeros((capacity, salts), np.int64)
    for length, salt, n in salted.groupBy("length", "salt").count().collect():
        seen[length, salt] = n
    before = np.cumsum(seen, axis=1) - seen
    where = places(arrange({k: int(n) for k, n in enumerate(seen.sum(axis=1)) if n}, capacity, groups))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, sequence, offset = f["length"].to_numpy(), np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            nth = before[length, f["salt"].to_numpy()] + f["nth"].to_numpy() - 1
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                first, base, at = where[int(k)]
                i = np.searchsorted(first, nth[rows], side="right") - 1
                sequence[rows], offset[rows] = base[i] + nth[rows] - first[i], at[i]
            yield f.drop(columns=["salt", "nth"]).assign(sequence_id=sequence, offset=offset)

    numbered = salted.withColumn("nth", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    short = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "nth").mapInPandas(assign, kind)
    full = table.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return short.unionByName(full)
