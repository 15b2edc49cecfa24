"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

Suffixes are compared to a depth of 200 bytes. Most start where nothing repeats, so
only the others are indexed. Each 200-byte window has an anchor, the 100-byte string
in it of least hash: equal windows have equal anchors. Consecutive windows of one
anchor are a unit.

1. Each group of documents asks which of its anchors' hashes occur anywhere else. Only
   units around such anchors go on.
2. Units that look alike by a 128-bit digest are one class. Two of each class, and all
   units without a like, go to shards, where a family of suffix arrays decides: a batch
   gets a suffix array, which is merge-scanned against each level for matches of full
   depth; then levels of equal size merge, so that n batches leave log n levels and each
   suffix is merged log n times.
   - Two of a class are matched as wholes, from the first byte of the first window to
     the last of the last: all their windows are repeated, and those of their likes.
   - Other units, the ends of repeated passages, are matched window by window with all
     distinct units of their anchor.
3. Each group removes what the matches cover.

Hashes choose what is compared, and stand for the further copies of a class; bytes decide
what is repeated. Documents are stored once, in buckets of their group, and each of the
passes reads them where they are.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import bucketed, parts, redealt, stored

DEPTH = 200
GRAM = DEPTH // 2
#: The most bytes that a unit's windows cover.
SPAN = 2 * DEPTH - GRAM
#: Bytes of text in a group of documents; anchors of one bucket.
GROUP_BYTES, BUCKET = 16 << 20, 2_000_000
#: Units of one shard and of one batch: matched by windows, and as wholes.
SHARD, BATCH, WHOLE_SHARD, WHOLE_BATCH = 1500, 128, 16_384, 2048
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_HIGH = np.uint64(0xFFFFFFFF00000000)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string of width bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(max(1 << 16, 1 << (n - 1).bit_length()))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = (total[width:] - total[:-width]) * down[: n - width + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values: minima from block borders to the right and to the left."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each unit, and its anchor's hash.

    The order of hashes is that of their upper half, then of place, so that the least is
    one and the same in equal windows even where strings recur within them.
    """
    if len(data) < DEPTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = rolling(data, GRAM)
    at = (sliding_least((h & _HIGH) | np.arange(len(h), dtype=np.uint64), DEPTH - GRAM + 1) & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return first, last, h[at[first]]


def _bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8)


class Family:
    """Suffix arrays of batches, to a fixed depth, merged geometrically.

    A level is the sorted distinct suffixes of one or more batches, with the number of one
    of each; repeated[i] says whether suffix i has an equal anywhere. peak is the most
    levels that there were at once.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.repeated = np.zeros(0, bool)
        self.peak = 0

    def add(self, windows: np.ndarray) -> None:
        """windows: array of byte strings of one width."""
        base = len(self.repeated)
        self.repeated = np.append(self.repeated, np.zeros(len(windows), bool))
        if not len(windows):
            return
        order = np.argsort(windows, kind="stable")  # the batch's suffix array
        ranked = windows[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        group = np.cumsum(new) - 1
        shared = np.bincount(group) > 1
        distinct, first = ranked[new], base + order[new]
        for _, other, owner in self.levels:
            at = np.minimum(np.searchsorted(other, distinct), len(other) - 1)
            same = other[at] == distinct
            shared |= same
            self.repeated[owner[at[same]]] = True
        self.repeated[base + order] = shared[group]
        self.levels.append((1, distinct, first))
        self.peak = max(self.peak, len(self.levels))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, i), (_, b, j) = self.levels.pop(), self.levels.pop()
            both, owner = np.concatenate([a, b]), np.concatenate([i, j])
            order = np.argsort(both, kind="stable")
            both, owner = both[order], owner[order]
            new = np.append(True, both[1:] != both[:-1])
            self.levels.append((2 * size, both[new], owner[new]))


def _ask(buckets: int) -> callable:
    def run(table: pa.Table) -> pa.Table:
        found = [units(x)[2] for x in _bytes(table.column("text"))]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        own = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        parts_ = [(h[edges[b] : edges[b + 1]], n[edges[b] : edges[b + 1]] > 1) for b in own]
        g = table.column("g")[0].as_py()
        return pa.table({
            "bucket": pa.array(own, pa.int32()), "g": pa.array([g] * len(own), pa.int32()),
            "once": pa.array([x[~m].tobytes() for x, m in parts_], pa.binary()), "more": pa.array([x[m].tobytes() for x, m in parts_], pa.binary()),
        })

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of each group's anchors, those that another group has too, or that the group has more than once."""
    once, more = ([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(c)] for c in ("once", "more"))
    every = np.sort(np.concatenate(once + more))
    known = np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate(more))
    rows = []
    for x, y in zip(once, more, strict=True):
        at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
        rows.append(np.concatenate([x[known[at] == x], y]) if len(known) else y)
    return pa.table({"g": table.column("g"), "found": pa.array([x.tobytes() for x in rows], pa.binary())})


def _candidates(docs: pa.Table, found: pa.Table) -> pa.Table:
    known = np.sort(np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(x.as_buffer(), np.uint64) for x in found.column("found")]))
    rows, firsts, lasts, hashes, digests = [], [], [], [], []
    for row, data in zip(docs.column("row").to_pylist(), _bytes(docs.column("text")), strict=True):
        first, last, h = units(data)
        if not len(h) or not len(known):
            continue
        keep = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        first, last, h = first[keep], last[keep], h[keep]
        view = memoryview(data)
        digests += [xxhash.xxh3_128_digest(view[s : e + DEPTH]) for s, e in zip(first.tolist(), last.tolist(), strict=True)]
        rows.append(np.full(len(h), row, np.int64))
        firsts.append(first)
        lasts.append(last)
        hashes.append(h.view(np.int64))
    join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    total = join(rows)
    g = docs.column("g")[0].as_py() if docs.num_rows else 0
    return pa.table({"g": pa.array(np.full(len(total), g, np.int32)), "row": total, "s": join(firsts), "e": join(lasts), "h": join(hashes), "k1": k[:, 0].copy(), "k2": k[:, 1].copy()})


def _spans(shards: int, wholes: int) -> callable:
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        """The bytes of each unit asked for, dealt to shards: wholes by their digest, others by anchor, and a hot anchor's windows by their own hash."""
        texts = dict(zip(docs.column("row").to_pylist(), _bytes(docs.column("text")), strict=True))
        out: list[tuple] = []
        for row, s, e, h, m, open_, k1, k2 in zip(*(asked.column(c).to_pylist() for c in ("row", "s", "e", "h", "m", "open", "k1", "k2")), strict=True):
            span = texts[row][s : e + DEPTH]
            if k1 is not None:
                out.append((-1 - k1 % wholes, row, s, open_, span.tobytes(), None, k1, k2))
                continue
            split = -(-m // SHARD)
            if split == 1:
                out.append((h % shards, row, s, open_, span.tobytes(), np.arange(e - s + 1, dtype=np.uint32).tobytes(), None, None))
                continue
            side = rolling(span, DEPTH) % np.uint64(split)
            for k in np.unique(side).tolist():
                shard = xxhash.xxh3_64_intdigest(f"{h}/{k}") >> 2
                out.append((shards + shard, row, s, open_, span.tobytes(), np.flatnonzero(side == k).astype(np.uint32).tobytes(), None, None))
        g = asked.column("g")[0].as_py() if asked.num_rows else 0
        cols = list(zip(*out, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        return pa.table([pa.array([g] * len(out), pa.int32()), *arrays], names=["g", "shard", "row", "s", "open", "span", "at", "k1", "k2"])

    return run


def _matched(table: pa.Table) -> pa.Table:
    """What a shard's family finds: classes (k1, k2) whose two are equal, or intervals (g, row, lo, hi) of repeated windows of open units."""
    return _whole(table) if table.column("shard")[0].as_py() < 0 else _ends(table)


_FOUND = pa.schema([("g", pa.int32()), ("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("levels", pa.int32())])


def _whole(table: pa.Table) -> pa.Table:
    family, k1, k2 = Family(), table.column("k1").to_numpy(), table.column("k2").to_numpy()
    for at in range(0, table.num_rows, WHOLE_BATCH):
        part = table.column("span").slice(at, WHOLE_BATCH).to_pylist()
        # filled up to one width, with the length last, in two bytes of which none is 0
        family.add(np.array([x.ljust(SPAN, b"\0") + bytes((1 + len(x) // 255, 1 + len(x) % 255)) for x in part], f"S{SPAN + 2}"))
    found = np.unique(np.stack([k1, k2], axis=1)[family.repeated], axis=0)
    n = len(found)
    none = pa.nulls(n, pa.int64())
    return pa.Table.from_arrays([pa.nulls(n, pa.int32()), none, none, none, pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(n, family.peak, np.int32))], schema=_FOUND)


def _ends(table: pa.Table) -> pa.Table:
    spans, ats = list(_bytes(table.column("span"))), [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("at")]
    family = Family()
    for lo in range(0, len(spans), BATCH):
        windows = [np.lib.stride_tricks.sliding_window_view(x, DEPTH)[at] for x, at in zip(spans[lo : lo + BATCH], ats[lo : lo + BATCH], strict=True)]
        family.add(np.concatenate(windows).view(f"S{DEPTH}").ravel())
    open_ = np.array(table.column("open").to_pylist(), bool)
    owner = np.repeat(np.arange(len(ats)), [len(x) for x in ats])
    place = np.concatenate(ats).astype(np.int64)
    kept = family.repeated & open_[owner]
    owner, place = owner[kept], place[kept]
    begin = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)) if len(owner) else np.zeros(0, bool)
    lo = np.flatnonzero(begin)
    hi = np.append(lo[1:], len(owner)) - 1 if len(lo) else lo
    g, row, s = (table.column(c).to_numpy() for c in ("g", "row", "s"))
    of, none = owner[lo], pa.nulls(len(lo), pa.int64())
    return pa.Table.from_arrays([pa.array(g[of], pa.int32()), pa.array(row[of]), pa.array(s[of] + place[lo]), pa.array(s[of] + place[hi]), none, none, pa.array(np.full(len(lo), family.peak, np.int32))], schema=_FOUND)


def _cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
    by_row: dict[int, list[int]] = {}
    lo, hi = marks.column("lo").to_numpy(), marks.column("hi").to_numpy()
    for i, row in enumerate(marks.column("row").to_pylist()):
        by_row.setdefault(row, []).append(i)
    n_bytes, removed, spans, kept = [], [], [], []
    for row, data in zip(docs.column("row").to_pylist(), _bytes(docs.column("text")), strict=True):
        own = by_row.get(row)
        n_bytes.append(len(data))
        if own is None:
            removed.append(0)
            spans.append([])
            kept.append(hashlib.sha256(data).hexdigest())
            continue
        step = np.zeros(len(data) + 1, np.int64)
        np.add.at(step, lo[own], 1)
        np.add.at(step, hi[own] + DEPTH, -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        removed.append(int(gone.sum()))
        spans.append([{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()])
        kept.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept_sha256": pa.array(kept, pa.string())})


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, stop of maximal removed runs) and kept_sha256 of every text.

    Each byte goes that is covered by a 200-byte string which also starts anywhere else,
    in this or another row; strings are judged on the input. Null and texts under 200
    bytes lose nothing. Repeated rows count as separate texts, so both lose what they
    share; extra columns are dropped; an empty table gives an empty one.
    """
    own, seen, found = matches(docs)
    classes = found.where("k1 IS NOT NULL").select("k1", "k2")
    marks = seen.join(classes, ["k1", "k2"]).select("g", "row", F.col("s").alias("lo"), F.col("e").alias("hi")).unionByName(found.where("k1 IS NULL").select("g", "row", "lo", "hi"))
    kind = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string"
    return own.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(_cut, kind)


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored texts in groups, the units around anchors that occur again, and what the families found.

    Texts are dealt to groups by row number, so that repeated rows are spread.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(parts(spark), -(-size // GROUP_BYTES))
    buckets = max(parts(spark), -(-size // (BUCKET * (DEPTH - GRAM) // 2)))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    own = bucketed(numbered.select("*", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g")), "g", "texts", size)
    asked = own.groupBy("g").applyInArrow(_ask(buckets), "bucket int, g int, once binary, more binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "g int, found binary").where(F.length("found") > 0)
    found = own.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_candidates, "g int, row long, s long, e long, h long, k1 long, k2 long")
    seen = stored(found, "units")
    one = F.struct("row", "s", "g", "e", "h")
    classes = stored(seen.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(one).alias("a"), F.max(one).alias("b")), "classes")
    distinct = classes.select("a.*", (F.col("n") == 1).alias("open"))
    anchors = distinct.groupBy("h").agg(F.count("*").alias("m"), F.max("open").alias("some")).where("m > 1 AND some").drop("some")
    none = F.lit(None).cast("long")
    by_window = distinct.join(redealt(anchors, "h"), "h").select("g", "row", "s", "e", "h", "m", "open", none.alias("k1"), none.alias("k2"))
    copies = classes.where("n > 1")
    as_whole = copies.select(F.explode(F.array("a", "b")).alias("x"), "k1", "k2").select("x.g", "x.row", "x.s", "x.e", "x.h", F.lit(0).cast("long").alias("m"), F.lit(False).alias("open"), "k1", "k2")
    n_open, n_copies = classes.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") > 1)).first()
    shards, wholes = max(parts(spark), -(-n_open // SHARD)), max(parts(spark), -(-2 * n_copies // WHOLE_SHARD))
    spans = own.groupBy("g").cogroup(by_window.unionByName(as_whole).groupBy("g")).applyInArrow(_spans(shards, wholes), "g int, shard long, row long, s long, open boolean, span binary, at binary, k1 long, k2 long")
    return own, seen, stored(spans.groupBy("shard").applyInArrow(_matched, "g int, row long, lo long, hi long, k1 long, k2 long, levels int"), "matches")
