"""Each query's best documents, by blocks of inner products.

Documents and queries are dealt to tasks as rows. A task holds one group of queries and
lets its documents stream past, a block at a time; of all pairs, only a query's k best so
far are kept, and only they leave the task. So nothing is as long as the pairs are many:
memory is bounded by a group of queries and a block, and what is shuffled grows with the
documents and the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6
#: Terms (and marks) of a group of queries; queries of a block; cells of each matrix of a block.
GROUP, QUERIES, CELLS = 1 << 20, 1024, 1 << 20
#: Unrounded scores that differ by more than this keep their order when they are rounded.
MARGIN = 1.1e-6


def best(
    entries: DataFrame, queries: DataFrame, k: int, positive: bool = False, shared: bool = False, integer: bool = False,
    marks: DataFrame | None = None, wanted: DataFrame | None = None, groups: DataFrame | None = None,
) -> DataFrame:
    """(qid, doc_id, score): at least each query's k best of all pairs, by score and then id; several tasks send k each.

    entries: (doc_id, term, value); queries: (qid, term, weight). Scores are rounded to six
    places, integer ones of codes are exact. positive: only scores above 0; shared: only
    pairs that have a term in common. wanted (qid, mark): only pairs of which the document
    has a mark that the query wants; marks (doc_id, mark), by default a document's terms.
    groups (doc_id, group): the k best groups, each by its best document; group is returned.
    """
    kinds = {f.name: f.dataType for f in entries.schema}
    width = _tasks(entries)
    docs = _rows(entries, "doc_id", "value", kinds["term"])
    asked = _rows(queries, "qid", "weight", kinds["term"])
    many = queries.agg(F.count("*")).first()[0]
    if wanted is not None:
        mark = marks.schema["mark"].dataType if marks is not None else kinds["term"]
        many += wanted.agg(F.count("*")).first()[0]
        asked = asked.join(_listed(wanted, "qid", mark), "qid")
        docs = docs.withColumn("m", F.lit(None).cast(f"array<{mark.simpleString()}>")) if marks is None else docs.join(_listed(marks, "doc_id", mark), "doc_id")
    if groups is not None:
        docs = docs.join(groups.select("doc_id", "group"), "doc_id")
    high = max(1, -(-many // GROUP))
    docs = docs.withColumn("h", F.explode(_range(high))).withColumn("g", F.col("h") * width + F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int")).drop("h")
    asked = asked.withColumn("w", F.explode(_range(width))).withColumn("g", F.pmod(F.xxhash64("qid"), F.lit(high)).cast("int") * width + F.col("w")).drop("w")
    both = asked.withColumnRenamed("qid", "id").withColumn("doc", F.lit(False)).unionByName(docs.withColumnRenamed("doc_id", "id").withColumn("doc", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartitionById(width * high, F.col("g")).sortWithinPartitions("g", "doc")
    schema = "qid long, doc_id long, score double" + ("" if groups is None else f", group {groups.schema['group'].dataType.simpleString()}")
    found = dealt.mapInArrow(_search(k, positive, shared, integer), schema)
    return found.withColumn("score", F.col("score").cast("long")) if integer else found


def _tasks(df: DataFrame) -> int:
    """How many parts the documents are dealt to: a few for each core, so that their results are few."""
    return max(2, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism))


def _range(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _rows(entries: DataFrame, key: str, value: str, term: object) -> DataFrame:
    """(key, t, x): each row's terms and values."""
    held = F.collect_list(F.struct(F.col("term").cast(term).alias("t"), F.col(value).cast("double").alias("x")))
    rows = entries.where(F.col(value).isNotNull()).groupBy(key).agg(held.alias("e"))
    return rows.select(F.col(key).cast("long").alias(key), F.col("e.t").alias("t"), F.col("e.x").alias("x"))


def _listed(marks: DataFrame, key: str, kind: object) -> DataFrame:
    return marks.groupBy(F.col(key).cast("long").alias(key)).agg(F.collect_set(F.col("mark").cast(kind)).alias("m"))


def _search(k: int, positive: bool, shared: bool, integer: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, blocks = None, [], None
        for batch in batches:
            g, doc = batch.column("g").to_numpy(), batch.column("doc").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(g.astype(np.int64) * 2 + doc)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(g)], strict=True):
                if hi == lo:
                    continue
                if g[lo] != group:
                    if blocks:
                        yield from blocks.results()
                    group, asked, blocks = g[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not doc[lo]:
                    asked.append(part)
                elif asked:
                    blocks = blocks or _Blocks(pa.Table.from_batches(asked), k, positive, shared, integer)
                    blocks.take(part)
        if blocks:
            yield from blocks.results()

    return run


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each value of a column of lists, and the values."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(whole)), lengths), whole.flatten()


def _places(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each value stands in known, or -1."""
    return pc.index_in(values, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(row: np.ndarray, column: np.ndarray, weights: np.ndarray | None, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(row * shape[1] + column, weights, shape[0] * shape[1]).reshape(shape)


class _Block:
    """Some queries of a group: their matrix, and the best documents so far, sorted by query, score and id."""

    def __init__(self, first: int, n: int, terms: np.ndarray, at: np.ndarray, weights: np.ndarray, marks: np.ndarray | None, mark_at: np.ndarray | None, known: int, known_marks: int) -> None:
        self.first, self.n = first, n
        self.local = np.full(known + 1, -1)  # the last is for terms that no query has
        own = np.unique(terms)
        self.local[own] = np.arange(len(own))
        self.width = len(own)
        column = self.local[terms]
        self.weights = _matrix(at, column, weights, (n, self.width))
        self.has = _matrix(at, column, None, (n, self.width)) > 0
        self.wants, self.mark_width = None, 0
        if marks is not None:
            self.local_mark = np.full(known_marks + 1, -1)
            own = np.unique(marks)
            self.local_mark[own] = np.arange(len(own))
            self.mark_width = len(own)
            self.wants = (_matrix(mark_at, self.local_mark[marks], None, (n, self.mark_width)) > 0).astype(np.float32)
        self.q, self.r, self.doc, self.group = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least, self.last = np.full(n, -np.inf), np.zeros(n, np.int64)


class _Blocks:
    """A group of queries, to which documents come."""

    def __init__(self, asked: pa.Table, k: int, positive: bool, shared: bool, integer: bool) -> None:
        self.k, self.positive, self.shared, self.integer = k, positive, shared, integer
        self.ids = asked.column("id").to_numpy()
        row, terms = _flat(asked.column("t"))
        weights = _flat(asked.column("x"))[1].to_numpy(zero_copy_only=False)
        self.known = terms.unique()
        at = _places(terms, self.known)
        self.marked = "m" in asked.column_names
        mark_row, marks = _flat(asked.column("m")) if self.marked else (np.zeros(0, np.int64), None)
        self.known_marks = marks.unique() if self.marked else None
        mark_at = _places(marks, self.known_marks) if self.marked else None
        self.grouped = "group" in asked.column_names
        self.groups: dict = {}
        self.group_type = asked.schema.field("group").type if self.grouped else None
        self.blocks, n, begin = [], len(self.ids), np.append(0, np.cumsum(np.bincount(row, minlength=len(self.ids))))
        first = 0
        while first < n:
            sizes = np.arange(1, min(QUERIES, n - first) + 1)
            cells = sizes * np.minimum(begin[first + sizes] - begin[first], len(self.known))
            last = first + max(1, int((cells <= CELLS).sum()))
            own, mine = (row >= first) & (row < last), (mark_row >= first) & (mark_row < last)
            self.blocks.append(_Block(first, last - first, at[own], row[own] - first, weights[own], mark_at[mine] if self.marked else None, mark_row[mine] - first, len(self.known), len(self.known_marks) if self.marked else 0))
            first = last

    def take(self, docs: pa.RecordBatch) -> None:
        ids = docs.column("id").to_numpy()
        row, terms = _flat(docs.column("t"))
        values = _flat(docs.column("x"))[1].to_numpy(zero_copy_only=False)
        at = _places(terms, self.known)
        mark_row, mark_at = None, None
        if self.marked:
            own = docs.column("m").null_count < len(ids)
            mark_row, marks = _flat(docs.column("m")) if own else (row, terms)
            mark_at = _places(marks, self.known_marks)
        groups = np.arange(len(ids))
        if self.grouped:
            groups = np.fromiter((self.groups.setdefault(x, len(self.groups)) for x in docs.column("group").to_pylist()), np.int64, len(ids))
        for block in self.blocks:
            self._pass(block, ids, groups, row, block.local[at], values, mark_row, block.local_mark[mark_at] if self.marked else None)

    def _pass(self, b: _Block, ids: np.ndarray, groups: np.ndarray, row: np.ndarray, column: np.ndarray, values: np.ndarray, mark_row: np.ndarray | None, mark: np.ndarray | None) -> None:
        """All documents of a batch by the queries of one block; those without a mark that any of these wants are left out."""
        hit = column >= 0
        row, column, values = row[hit], column[hit], values[hit]
        if mark is not None:
            hit = mark >= 0
            mark_row, mark = mark_row[hit], mark[hit]
            left = np.zeros(len(ids), bool)
            left[mark_row] = True
        elif self.positive or self.shared:
            left = np.zeros(len(ids), bool)
            left[row] = True
        else:
            left = np.ones(len(ids), bool)
        if not left.all():
            new = np.cumsum(left) - 1
            hit = left[row]
            row, column, values = new[row[hit]], column[hit], values[hit]
            mark_row = None if mark is None else new[mark_row]
            ids, groups = ids[left], groups[left]
        n = len(ids)
        step = max(1, CELLS // max(1, b.n, b.width, b.mark_width))
        starts = np.arange(0, n + step, step)
        edges = np.searchsorted(row, starts)
        mark_edges = None if mark is None else np.searchsorted(mark_row, starts)
        for i, lo in enumerate(range(0, n, step)):
            hi, part = min(n, lo + step), slice(edges[i], edges[i + 1])
            at = (row[part] - lo, column[part])
            wanted = None
            if mark is not None:
                part_m = slice(mark_edges[i], mark_edges[i + 1])
                has = (_matrix(mark_row[part_m] - lo, mark[part_m], None, (hi - lo, b.mark_width)) > 0).astype(np.float32)
                wanted = b.wants @ has.T > 0
            self._block(b, ids[lo:hi], groups[lo:hi], at, values[part], wanted)

    def _block(self, b: _Block, ids: np.ndarray, groups: np.ndarray, at: tuple[np.ndarray, np.ndarray], values: np.ndarray, wanted: np.ndarray | None) -> None:
        shape = (len(ids), b.width)
        scores = _products(b, _matrix(*at, values, shape), at)
        if self.shared:
            common = b.has.astype(np.float32) @ (_matrix(*at, None, shape) > 0).astype(np.float32).T > 0
            wanted = common if wanted is None else wanted & common
        if wanted is not None:
            scores[~wanted] = -np.inf
        margin = 0.0 if self.integer else MARGIN
        low = b.least.copy()
        if self.grouped:
            order = np.argsort(groups, kind="stable")
            scores, ids, groups = scores[:, order], ids[order], groups[order]
            wanted = None if wanted is None else wanted[:, order]
            starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            most = np.repeat(np.fmax.reduceat(scores, starts, axis=1), np.diff(np.append(starts, len(groups))), axis=1)
            may = ~(scores < np.fmax(most, low[:, None]) - margin)
        else:
            if len(ids) > self.k and (low == -np.inf).any():  # NaN would be the largest, so it can only lower the bound
                low = np.fmax(low, np.partition(np.where(np.isnan(scores), -np.inf, scores), len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            may = ~(scores < (low - margin)[:, None])
        if wanted is not None:
            may &= wanted
        q, d = np.nonzero(may)
        r, doc, group = scores[q, d], ids[d], groups[d]
        if not self.integer:
            r = rounded(r)
        keep = ~((r < b.least[q]) | ((r == b.least[q]) & (doc >= b.last[q]) & (b.least[q] > -np.inf)))
        if self.positive:
            keep &= ~(r <= 0)
        if keep.any():
            self._merge(b, q[keep], r[keep], doc[keep], group[keep])

    def _merge(self, b: _Block, q: np.ndarray, r: np.ndarray, doc: np.ndarray, group: np.ndarray) -> None:
        touched = np.zeros(b.n, bool)
        touched[q] = True
        old = touched[b.q]
        rest = ~old
        q, r, doc, group = np.append(b.q[old], q), np.append(b.r[old], r), np.append(b.doc[old], doc), np.append(b.group[old], group)
        order = np.lexsort((doc, np.where(np.isnan(r), -np.inf, -r), ~np.isnan(r), q))
        q, r, doc, group = q[order], r[order], doc[order], group[order]
        if self.grouped:
            one = np.sort(np.unique(q * (len(self.groups) + 1) + group, return_index=True)[1])
            q, r, doc, group = q[one], r[one], doc[one], group[one]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        full = place == self.k - 1
        b.least[q[full]], b.last[q[full]] = np.where(np.isnan(r[full]), np.inf, r[full]), doc[full]
        b.q, b.r = np.append(b.q[rest], q[kept]), np.append(b.r[rest], r[kept])
        b.doc, b.group = np.append(b.doc[rest], doc[kept]), np.append(b.group[rest], group[kept])

    def results(self) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(self.groups), self.group_type) if self.grouped else None
        for b in self.blocks:
            columns = {"qid": pa.array(self.ids[b.first + b.q], pa.int64()), "doc_id": pa.array(b.doc, pa.int64()), "score": pa.array(b.r, pa.float64())}
            if self.grouped:
                columns["group"] = names.take(pa.array(b.group))
            yield pa.RecordBatch.from_pydict(columns)


def _products(b: _Block, values: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products, queries by documents. A term counts only where both have it, also beside infinite values."""
    odd = np.flatnonzero(~(np.isfinite(values).all(axis=0) & np.isfinite(b.weights).all(axis=0)))
    if not len(odd):
        return b.weights @ values.T
    has = _matrix(*at, None, values.shape) > 0
    plain, weights = values.copy(), b.weights.copy()
    plain[:, odd], weights[:, odd] = 0, 0
    scores = weights @ plain.T
    with np.errstate(invalid="ignore"):
        for t in odd:
            scores += np.where(b.has[:, t, None] & has[None, :, t], b.weights[:, t, None] * values[None, :, t], 0.0)
    return scores


def rounded(scores: np.ndarray) -> np.ndarray:
    """To DIGITS places, halves away from zero; no negative zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.trunc(scores * 10.0**DIGITS + np.copysign(0.5, scores)) / 10.0**DIGITS
    return np.where(np.abs(scores) < 1e9, near, scores) + 0.0
