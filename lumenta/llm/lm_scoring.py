"""Language-model scores: the marginal probability of a text over all its segmentations.

Words are counted over the whole corpus, map-side first. The weights of a fixed piece
vocabulary start from the scores in its file and are fitted to the running words of the
training documents by expectation maximisation. A word's probability is the sum over all
its segmentations into pieces, found by the forward recursion of lattice.py; a text's is
the product of its words', each followed by the end or not.

There is one set of weights for each class of training documents (their lang, where the
table has one), and a text's probability is also summed over the classes: a text's own
class is never looked at.

Beside that, a word seen in training may also have an edge of its own in the lattice, of
its count less a discount; what the discounts free is the weight of the segmentations
into pieces, and of words seen elsewhere. That model's score is a further column.

Each distinct word is scored once, and documents look their words up: they are dealt to
groups of a bounded number of bytes, a group asks for each of its distinct words once,
and the answers come back to it. No vocabulary is collected or broadcast, only piece
weights, whose number is fixed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm import lattice
from lumenta.llm.common import id_crc, stored

#: Bytes of text in a group of documents.
GROUP_BYTES = 24 << 20
#: Distinct words that a task counts before it hands its counts on.
WORDS_HELD = 400_000
ROUNDS = 2
SMOOTH = 0.01
#: Classes with weights of their own, the largest ones, unless the caller says otherwise; the documents of all others share one more set.
CLASSES = 12
#: The part of a class's unseen words that words seen in other classes get.
ELSEWHERE = 0.3


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes know only ASCII, so both steps mean just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(word, n0, n1, ...): each word's count in the training rows of each class; the null word has the numbers of rows.

    docs: (text, class int), class null for rows that are not learned from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {k: Counter() for k in range(-1, classes)}
        ends = [0] * classes

        def out(rows: list[tuple]) -> pa.RecordBatch:
            word, kind, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()).cast(pa.string()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], names=["word", "class", "n"])

        def flush() -> pa.RecordBatch:
            rows = [(w, k, n if k >= 0 else 0) for k, c in seen.items() for w, n in c.items()]
            for c in seen.values():
                c.clear()
            return out(rows)

        for batch in batches:
            for text, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                k = -1 if k is None else k
                seen[k].update(words_of(text.as_py()))
                if k >= 0:
                    ends[k] += 1
                if sum(map(len, seen.values())) > WORDS_HELD:
                    yield flush()
        yield flush()
        yield out([(None, k, n) for k, n in enumerate(ends)])

    parts = docs.select("text", "class").mapInArrow(run, "word string, class int, n long")
    return parts.groupBy("word").agg(*[F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(classes)])


def fit(words: DataFrame, classes: int, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights (pieces, classes) fitted to each class's words; the driver sees one number for each piece and class."""
    model = lattice.lattice(vocabulary)
    logp = np.repeat(model.prior()[:, None], classes, axis=1)
    names = [f"n{k}" for k in range(classes)]
    learned = words.where(F.col("word").isNotNull() & (F.greatest(F.lit(0), *names) > 0))
    for _ in range(rounds):

        def run(frames: Iterator[pd.DataFrame], logp: np.ndarray = logp) -> Iterator[pd.DataFrame]:
            total = np.zeros(logp.shape)
            for f in lattice.gathered(frames):
                total += lattice.lattice(vocabulary).expected(f["word"].tolist(), f[names].to_numpy(float), logp)
            piece, kind = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "class": kind, "expected": total[piece, kind]})

        counts = np.zeros((model.size, classes))
        for piece, kind, n in learned.mapInPandas(run, "piece int, class int, expected double").groupBy("piece", "class").agg(F.sum("expected")).collect():
            counts[piece, kind] = n
        logp = lattice.normalised(counts, SMOOTH)
    return logp


class Weights:
    """How much of a class's token is the end, a word's own edge, or its pieces.

    For each class: ends, running words, distinct words, and how many came once and twice,
    which gives the discount by the Good-Turing ratio.
    """

    def __init__(self, ends: np.ndarray, words: np.ndarray, types: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        self.prior = np.log10((ends + 1) / (ends + 1).sum())
        self.end = (ends + 0.5) / (ends + words + 1)
        self.words, self.total = np.maximum(words, 1), max(1, words.sum())
        self.discount = np.where((once > 0) & (twice > 0), once / np.maximum(1, once + 2 * twice), 0.5)
        self.rest = np.where(words > 0, self.discount * types / self.words, 1.0)
        self.elsewhere = ELSEWHERE if words.sum() else 0.0

    def log10(self, count: np.ndarray, lp: np.ndarray) -> np.ndarray:
        """Log10 probabilities (n, classes) of words with edges of their own, from their training counts and their pieces' natural log marginals."""
        own = np.maximum(count - self.discount, 0) / self.words + self.rest * self.elsewhere * count.sum(axis=1, keepdims=True) / self.total
        with np.errstate(divide="ignore"):
            return (np.logaddexp(np.log(own), np.log(self.rest * (1 - self.elsewhere)) + lp) + np.log(1 - self.end)) / math.log(10)


def score(docs: DataFrame, train: F.Column | None = None, vocabulary: str | None = None, rounds: int = ROUNDS, kind: str = "lang", most: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and word_score of every text.

    train says which rows are learned from; by default those whose CRC-32 of the id as
    text isn't 0 modulo 10. A text's tokens are its words and one end. base_score is the
    smoothed word unigram's log10 probability, score that of the lattices of pieces,
    word_score that of the lattices in which known words have edges too. Classes are the
    values of kind, if docs has that column; null is one of them; beyond the most largest
    ones, all others' documents make one. Null texts count as empty: an end alone. Of rows
    equal in id and text one is scored, and the result repeated; extra columns are
    dropped; an empty table gives an empty one; without training rows only the
    vocabulary's own scores count, and an end is as likely as not. A word without a space
    for megabytes needs no more memory than its characters.
    """
    path = vocabulary or lattice.vocabulary()
    train = (id_crc(F.col("doc_id")) % 10 != 0) if train is None else train
    label = F.col(f"`{kind}`").cast("string") if kind in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", train.alias("train"), label.alias("kind"))
    known = [r[0] for r in rows.where("train").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(most + 1).collect()]
    classes = max(1, len(known))
    number = F.coalesce(*[F.when(F.col("kind").eqNullSafe(F.lit(v)), F.lit(i)) for i, v in enumerate(known[:most])], F.lit(classes - 1))
    rows = rows.select("doc_id", "text", "train", F.when(F.col("train"), number).alias("class"))
    counted = stored(word_counts(rows, classes), "words")
    names = [f"n{k}" for k in range(classes)]
    word, every = F.col("word").isNotNull(), sum((F.col(c) for c in names[1:]), F.col(names[0]))
    totals = counted.agg(
        F.count_if(word & (every > 0)), *[F.coalesce(F.sum(F.when(~word, F.col(c))), F.lit(0)) for c in names], *[F.coalesce(F.sum(F.when(word, F.col(c))), F.lit(0)) for c in names],
        *[F.count_if(word & (F.col(c) > 0)) for c in names], *[F.count_if(word & (F.col(c) == k)) for k in (1, 2) for c in names],
    ).first()
    ends, words, types, once, twice = np.array([int(x or 0) for x in totals[1:]], float).reshape(5, classes)
    weights = Weights(ends, words, types, once, twice)
    n_ends = int(ends.sum())
    n, v = int(words.sum()) + n_ends, int(totals[0]) + (n_ends > 0)
    logp = fit(counted, classes, path, rounds)

    def marginal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in lattice.gathered(frames):
            lp = lattice.lattice(path).score(f["word"].tolist(), logp)
            yield pd.DataFrame({"word": f["word"], "counts": list(f[names].to_numpy(np.int64)), "lp": list(lp.astype(np.float32))})

    table = counted.where(word).mapInPandas(marginal, "word string, counts array<long>, lp array<float>")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"), "doc_id", "text", "train").repartition("g")
    dealt = dealt.groupBy("g", "doc_id", "text", "train").agg(F.count("*").alias("times"))

    def ask(table: pa.Table) -> pa.Table:
        own: set[bytes] = set()
        for text in table.column("text"):
            own.update(words_of(text.as_py()))
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(own), pa.int32()), "word": pa.array(own, pa.binary()).cast(pa.string())})

    asked = dealt.groupBy("g").applyInArrow(ask, "g int, word string")
    answers = asked.join(table, "word").select("g", "word", "counts", "lp")
    floor, below = 0.1, n + 0.1 * (v + 1)
    end_base, end_lp = math.log10((n_ends + floor) / below), weights.prior + np.log10(weights.end)

    def join(own: pa.Table, found: pa.Table) -> pa.Table:
        words = {w: i for i, w in enumerate(found.column("word").cast(pa.binary()).to_pylist())}
        counts, lp = (found.column(c).combine_chunks().flatten().to_numpy().reshape(-1, classes) for c in ("counts", "lp"))
        count = counts.sum(axis=1)
        base = np.log10((count + floor) / below)
        # base, pieces, words: summed over a text at once
        each = np.concatenate([base[:, None], lp / math.log(10) + np.log10(1 - weights.end), weights.log10(counts, lp.astype(np.float64))], axis=1)
        known = count > 0
        tokens, seen, sums = [], [], np.zeros((own.num_rows, each.shape[1]))
        for i, text in enumerate(own.column("text")):
            at = np.fromiter(map(words.__getitem__, words_of(text.as_py())), np.int64)
            tokens.append(len(at) + 1)
            seen.append(int(known[at].sum()) + (n_ends > 0))
            sums[i] = each[at].sum(axis=0)
        over = lambda lp: np.logaddexp.reduce((lp + end_lp) * math.log(10), axis=1) / math.log(10)
        return pa.table({
            "doc_id": own.column("doc_id"), "held_out": pa.array([not x for x in own.column("train").to_pylist()], pa.bool_()), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(seen, pa.int64()),
            "train_tokens": pa.array([n] * len(tokens), pa.int64()), "base_score": pa.array(sums[:, 0] + end_base), "score": pa.array(over(sums[:, 1 : classes + 1])), "word_score": pa.array(over(sums[:, classes + 1 :])),
            "times": own.column("times"),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double"
    scored = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(join, schema + ", times long")
    return scored.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
