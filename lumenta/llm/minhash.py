"""Near-duplicate documents by MinHash: bands, signatures, exact confirmation, components.

1. Every text becomes a set of word shingles. Texts with equal sets are one class, of
   which one row goes on, so copies cost nothing further.
2. 150 universal hash minima in bands of five put classes into buckets. A bucket's
   first member is its hub; every other is confirmed against the hub on full sets.
   So a bucket of m members makes m - 1 pairs and not m * m / 2.
3. Alternating large-star and small-star steps turn confirmed links into components.
4. Buckets whose members are not all in one component may still hide links. Jaccard
   distance is a metric and distances to the hub are known exactly, so members whose
   distances differ by more than the threshold allows cannot be linked; pairs left are
   compared by signature, block by block, each in the first bucket that it shares, and
   those that can reach the threshold are confirmed on full sets on the spot, unless
   links found before have joined them. Then components are completed.

No pair that shares a bucket is left out but by the metric or by a signature five
standard deviations low; a linked pair shares no bucket with a probability under
3e-8 at the threshold 0.85 and 7e-6 at 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import fresh, redealt, stored

BANDS, ROWS = 30, 5
#: Members, and bytes of their sets, of one side of a block in the comparison by signature.
SIDE, SIDE_BYTES = 1000, 16 << 20
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = _RNG.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, A-Z lower-cased; the whole sequence if shorter."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(words.__getitem__, low), np.uint64, len(low))
    k = min(k, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _scramble(out * _MIX[i % 8] + h[i : i + n])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set, in blocks so that long texts need no more memory."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(least, (_A[:, None] * x[None, at : at + 4096] + _B[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _scramble(out * _MIX[0] + column.astype(np.uint64))
    return out.view(np.int64)


def described(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n, d1, d2 (the set's 128-bit digest), bands and signature of each row, with a row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows: list[tuple] = []
            with np.errstate(over="ignore"):
                for text in batch.column(2):
                    s = shingles(text.as_py(), k, words)
                    if not len(s):
                        rows.append((0, 0, 0, None, None))
                        continue
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    least = minima(s)
                    rows.append((len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), band_keys(least), (least >> np.uint32(16)).astype("<u2").tobytes()))
            n, d1, d2, bands, sig = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "n", "d1", "d2", "bands", "sig"])

    kind = "doc_id long, text_hash long, n long, d1 long, d2 long, bands array<long>, sig binary"
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, kind)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "minhash")


def sets_of(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(row, set) of the rows in needed (row, doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            with np.errstate(over="ignore"):
                sets = [shingles(t.as_py(), k, words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["row", "set"])

    texts = docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__h"), "text")
    found = needed.join(texts, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")))
    return found.select("row", "text").mapInArrow(run, "row long, set binary")


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """The size of the intersection of two sorted sets, neither empty."""
    if len(p) > len(q):
        p, q = q, p
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union for each distinct pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = _common(p, q)
                both.append(same)
                either.append(len(p) + len(q) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    a, b = (sets.select(F.col("row").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, both long, either long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the least node that can be reached.

    Large-star: each node hands its larger neighbours to its least one. Small-star: each
    node hands its smaller neighbours, and itself, to the least of them. They alternate
    until nothing changes. Minima are aggregated map-side and joined back, so that no
    node's neighbours are gathered in one place. Links of a node with itself and repeated
    links count for nothing, links with a null end are none; no links, no rows.
    """

    def stars(both: DataFrame) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(redealt(least, "u"), "u")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    before = None
    while (now := state(edges)) != before:
        before = now
        if not now[0]:
            break
        twice = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(twice).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = stars(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small, "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _reaches(x: np.ndarray, y: np.ndarray, x_bands: np.ndarray, y_bands: np.ndarray, band: int, least: float) -> np.ndarray:
    """Which of the pairs x × y can reach the threshold by signature and share no bucket before this band's.

    Buckets are told by their keys: signatures hold the upper half of each minimum, and of
    long texts these agree by chance.
    """
    same = np.zeros((len(x), len(y)), np.int16)
    met = np.zeros((len(x), len(y)), bool)
    for k in range(BANDS):
        equal = x[:, k * ROWS : (k + 1) * ROWS, None] == y.T[None, k * ROWS : (k + 1) * ROWS, :]
        same += equal.sum(axis=1, dtype=np.int16)
        if k < band:
            met |= x_bands[:, k, None] == y_bands[None, :, k]
    return (same >= least) & ~met


def left_over(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, from members (bucket, band, row, sig, bands, set, root, away) of buckets that have more than one.

    A pair is looked at in the first bucket that it shares, and not at all if the block's
    links have joined its components; so a block has fewer links than members. Columns
    hold no nulls; no members, no links. A bucket of m members that stays open costs
    m * m / 1000 copied rows: only texts that share a bucket without being in one
    component come here.
    """
    t = percent / 100
    least = (t - 5 * math.sqrt(t * (1 - t) / (BANDS * ROWS))) * BANDS * ROWS
    far = 1 - t + 1e-9

    def run(table: pa.Table) -> pa.Table:
        own = table.combine_chunks()
        row, root, away, side = (own.column(c).to_numpy() for c in ("row", "root", "away", "side"))
        sig = np.frombuffer(b"".join(own.column("sig").to_pylist()), "<u2").reshape(len(row), -1)
        bands = own.column("bands").combine_chunks().flatten().to_numpy().reshape(len(row), -1)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in own.column("set")]
        band, i, j = (own.column(c)[0].as_py() for c in ("band", "i", "j"))
        x, y = np.flatnonzero(side == i), np.flatnonzero(side == j)
        up: dict[int, int] = {}

        def top(r: int) -> int:
            while (n := up.get(r, r)) != r:
                r = n
            return r

        links = []
        for at in range(0, len(x), 64):
            part = x[at : at + 64]
            ok = (np.abs(away[part][:, None] - away[y][None, :]) <= far) & (root[part][:, None] != root[y][None, :])
            if i == j:
                ok &= row[part][:, None] < row[y][None, :]
            if not ok.any():
                continue
            ok &= _reaches(sig[part], sig[y], bands[part], bands[y], band, least)
            for p, q in zip(*np.nonzero(ok), strict=True):
                p, q = part[p], y[q]
                a, b = top(int(root[p])), top(int(root[q]))
                if a == b:
                    continue
                both = _common(sets[p], sets[q])
                if both * 100 >= (len(sets[p]) + len(sets[q]) - both) * percent:
                    up[a] = b
                    links.append((int(max(row[p], row[q])), int(min(row[p], row[q]))))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sizes = members.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / SIDE, F.sum(F.length("set")) / SIDE_BYTES)).cast("int").alias("sides"))
    dealt = members.join(redealt(sizes, "bucket"), "bucket").withColumn("side", F.pmod(F.xxhash64("row"), F.col("sides")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    return dealt.select("bucket", "band", "i", "j", "side", "row", "root", "away", "sig", "bands", "set").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash and component (any number) for every row of docs (doc_id, text).

    Rows whose sets of k-word shingles have 100 * intersection >= percent * union are
    linked; component_id is the least doc_id that can be reached over links. Texts
    without words have no shingles and are linked with nothing. Equal sets are linked,
    so repeated rows are one component (each stays a row, kept if its id is the
    component's). A null id never is a component's id if a row linked with it has one.
    Extra columns are dropped; an empty table gives an empty one.
    """
    rows = described(docs, k)
    some = rows.where("n > 0")
    copies = some.groupBy("d1", "d2").agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    classes = stored(some.join(redealt(copies, "d1", "d2"), ["d1", "d2"], "left").select("row", F.coalesce("first", "row").alias("class"), "doc_id", "text_hash", "n"), "classes")
    heads = rows.where("n > 0").join(classes.where("row = class").select("row"), "row", "left_semi")
    banded = heads.select("row", F.posexplode("bands").alias("band", "bucket"))
    full = banded.groupBy("bucket").agg(F.min("row").alias("hub"), F.max("row").alias("top")).where("hub <> top").drop("top")
    members = stored(banded.join(redealt(full, "bucket"), "bucket"), "members")
    pairs = members.where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b")).distinct()
    needed = classes.join(members.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "text_hash")
    sets = stored(sets_of(docs, needed, k).dropDuplicates(["row"]), "sets")
    linked = F.col("both") * 100 >= F.col("either") * percent
    checked = stored(confirmed(pairs, sets), "pairs")
    links = checked.where(linked).select("a", "b")
    first = components(links)
    placed = members.join(first, F.col("row") == F.col("node"), "left").select("bucket", "band", "row", "hub", F.coalesce("root", "row").alias("root"))
    away = checked.select(F.col("a").alias("__a"), F.col("b").alias("__b"), (1 - F.col("both") / F.col("either")).alias("away"))
    placed = placed.join(away, (F.col("row") == F.col("__a")) & (F.col("hub") == F.col("__b")), "left").select("bucket", "band", "row", "hub", "root", F.coalesce("away", F.lit(0.0)).alias("away"))
    placed = stored(placed, "placed")
    # the hub's own component, and the nearest member outside it: nearer ones of the component cannot be linked across
    at_hub = placed.where("row = hub").select(F.col("bucket").alias("__k"), F.col("root").alias("__r"))
    sided = placed.join(at_hub, F.col("bucket") == F.col("__k")).withColumn("outside", F.col("root") != F.col("__r"))
    mixed = sided.where("outside").groupBy("bucket").agg(F.min("away").alias("nearest"), F.count("*").alias("n_outside")).withColumnRenamed("bucket", "__k2")
    open_ = sided.join(mixed, F.col("bucket") == F.col("__k2")).where(F.col("outside") | (F.col("away") >= F.col("nearest") - (1 - percent / 100) - 1e-9)).where("row <> hub").select("bucket", "band", "row", "root", "away")
    open_ = stored(open_.join(rows.select("row", "sig", "bands"), "row").join(sets, "row"), "open")
    again = left_over(open_, percent)
    final = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(again))
    rooted = classes.join(final, F.col("class") == F.col("node"), "left").select("row", F.coalesce("root", "class").alias("root"))
    named = rows.select("row", "doc_id", "n", "text_hash").join(rooted, "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.join(redealt(least, "root"), "root")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", F.col("root").alias("component"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one of each component stays, with all their columns.

    Of repeated ids within a component one row stays. Rows without words all stay.
    """
    near = stored(near_duplicates(docs.select("doc_id", "text"), k, percent), "near")
    one = near.where("n_shingles > 0 AND kept").groupBy("doc_id", "component").agg(F.min("text_hash").alias("text_hash"))
    d, h = fresh(docs, "__id"), fresh(docs, "__hash")
    stay = one.select("doc_id", "text_hash").unionByName(near.where("n_shingles = 0").select("doc_id", "text_hash")).distinct().withColumnsRenamed({"doc_id": d, "text_hash": h})
    mark = fresh(docs, "__text_hash")
    out = docs.withColumn(mark, F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(mark) == F.col(h)), "left_semi")
    twice = near.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    if not twice.isEmpty():
        repeated = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(mark) == F.col(h))
        own = fresh(docs, "__own")
        once = out.join(twice, repeated, "left_semi").groupBy("doc_id", mark).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(own))
        return out.join(twice, repeated, "left_anti").drop(mark).unionByName(once.select(f"{own}.*"))
    return out.drop(mark)
