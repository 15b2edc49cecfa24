"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary, fitted to
labelled text by expectation maximisation over the lattices of its words. A text's
probability in a language is the product of its words', each the sum over all
segmentations (lattice.py); the best language is predicted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm import lattice
from lumenta.llm.common import id_crc

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled documents of each language that the fit reads, about, chosen by a hash of their ids.
SAMPLE = 3000
ROUNDS = 2
SMOOTH = 0.5
#: Characters of text whose words are scored together.
TOGETHER = 4 << 20


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if no character is a letter."""
    found = LETTERS.findall((text or "").lower())
    return found if any(map(str.isalpha, found)) else []


class Model:
    """langs in order, log weights (pieces, langs) and log priors (langs)."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, vocabulary: str) -> None:
        self.langs, self.logp, self.prior, self.vocabulary = langs, logp, prior, vocabulary

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its posterior probability for each text; und and 0 without letters."""
        model, langs, scores = lattice.lattice(self.vocabulary), [], []
        for group in lattice.chunks(texts, lambda t: len(t or "") + 1, TOGETHER):
            split = [words_of(t) for t in group]
            index: dict[str, int] = {}
            at = [np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int64, len(ws)) for ws in split]
            table = model.score(list(index), self.logp) if index and self.langs else None
            for own in at:
                if not len(own) or table is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                lp = table[own].sum(axis=0) + self.prior
                p = np.exp(lp - lp.max())
                best = int(np.argmax(lp))
                langs.append(self.langs[best])
                scores.append(float(p[best] / p.sum()))
        return langs, scores


def fit(docs: DataFrame, train: F.Column | None = None, vocabulary: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model of the (text, lang) of training rows; null langs, and texts without letters, teach nothing.

    By default rows are trained on whose CRC-32 of the id as text isn't 2 modulo 4. About
    sample documents of each language are read, all if it has no more; priors count all.
    What reaches the driver is one number for each language and piece.
    """
    path = vocabulary or lattice.vocabulary()
    train = (id_crc(F.col("doc_id")) % 4 != 2) if train is None else train
    rows = docs.select("doc_id", "text", "lang").where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(have)
    model = lattice.lattice(path)
    if not langs:
        return Model([], np.zeros((model.size, 0)), np.zeros(0), path)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / have[k]))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text.as_py()))
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            cols = list(zip(*flat, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "word", "n"])

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    words = counted.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(langs)]).persist()
    logp = np.repeat(model.prior()[:, None], len(langs), axis=1)
    for _ in range(rounds):

        def run(frames: Iterator[pd.DataFrame], logp: np.ndarray = logp) -> Iterator[pd.DataFrame]:
            total = np.zeros((lattice.lattice(path).size, len(langs)))
            for f in lattice.gathered(frames):
                total += lattice.lattice(path).expected(f["word"].tolist(), f[[f"n{i}" for i in range(len(langs))]].to_numpy(float), logp)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "expected": total[piece, lang]})

        counts = np.zeros((model.size, len(langs)))
        for piece, lang, n in words.mapInPandas(run, "piece int, lang int, expected double").groupBy("piece", "lang").agg(F.sum("expected")).collect():
            counts[piece, lang] = n
        logp = lattice.normalised(counts, SMOOTH)
    words.unpersist()
    total = sum(have.values())
    return Model(langs, logp, np.log(np.array([have[k] / total for k in langs])), path)


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs (all by default) and lang_pred, score; text alone is looked at.

    Null texts and those without a letter are und with score 0, and so is every text if
    no language was learned. Columns named lang_pred or score in docs are replaced.
    """
    keep = [c for c in (columns or docs.columns) if c.lower() not in ("lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)
