"""Segmentation lattices over a fixed public piece vocabulary.

A word's probability under a unigram model of pieces is the sum over all its
segmentations, found by a forward recursion in log space. Words of one length go
through the recursion together, a column of the lattice at a time. A character that
is no piece is spelled by its UTF-8 bytes' pieces. Pieces never span white space, so
a text's probability is the product of its words' and nothing is lost by scoring
each distinct word once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

BEGIN = "▁"  # marks a word's beginning in the vocabulary
#: Longer words go through the recursion one at a time, and still longer ones in parts of a bounded size.
TOGETHER, LONG, PART = 48, 192, 2048
BLOCK = 4096
_MULTIPLIER, _SPREAD, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20


def vocabulary() -> str:
    """The default vocabulary's path on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.bytes = np.array([i for i in range(self.size) if model.is_byte(i)])
        self.end = model.eos_id()
        self.longest = max(map(len, self.ids))
        self.scores = np.array([model.get_score(i) for i in range(self.size)])
        self._build()

    def prior(self) -> np.ndarray:
        """Log weights from the vocabulary's own scores: a piece of merge rank r weighs 1 / (r + 10); what has no rank, 1e-7."""
        ranked = np.zeros(self.size, bool)
        ranked[list(self.ids.values())] = True
        rank = np.where(ranked & (self.scores <= 0) & (self.scores > -1e8), -self.scores, np.inf)
        weight = np.maximum(1 / (rank + 10), 1e-7)
        return np.log(weight / weight.sum())

    def _build(self) -> None:
        """A hash table of the pieces with linear probing, so that whole arrays are looked up at once."""
        self.keys, self.values = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, -1, np.int32)
        with np.errstate(over="ignore"):
            for piece, i in self.ids.items():
                h = np.uint64(0)
                for c in piece:
                    h = h * _MULTIPLIER + np.uint64(ord(c) + 1)
                at = int(h * _SPREAD >> np.uint64(64 - _BITS))
                while self.values[at] >= 0:
                    if self.keys[at] == h:
                        raise ValueError("two pieces have one hash")
                    at = (at + 1) % (1 << _BITS)
                self.keys[at], self.values[at] = h, i

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = (h * _SPREAD >> np.uint64(64 - _BITS)).astype(np.int64)
        held = self.values[at]
        found = np.where(self.keys[at] == h, held, -1)
        rest = np.flatnonzero((found < 0) & (held >= 0))  # places that another piece holds
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << _BITS) - 1)
            held = self.values[at[rest]]
            same = (self.keys[at[rest]] == h[rest]) & (held >= 0)
            found[rest[same]] = held[same]
            rest = rest[~same & (held >= 0)]
        return found

    def _spelled(self, codes: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log weights of characters spelled by bytes."""
        each = {c: logp[self.bytes[list(chr(c).encode("utf-8", "surrogatepass"))]].sum(axis=0) for c in np.unique(codes).tolist()}
        return np.array([each[c] for c in codes.tolist()])

    def _columns(self, codes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each end j from 1: the starts i of edges that some word has, with each word's piece or -1."""
        open_: list[np.ndarray] = []
        for j in range(1, codes.shape[1] + 1):
            c = codes[:, j - 1].astype(np.uint64) + np.uint64(1)
            open_ = [h * _MULTIPLIER + c for h in open_[-(self.longest - 1) :]] + [c]
            first = j - len(open_)
            edges = [(first + k, self._find(h)) for k, h in enumerate(open_)]
            yield j, [(i, ids) for i, ids in edges if i == j - 1 or (ids >= 0).any()]

    def _forward(self, codes: np.ndarray, logp: np.ndarray, keep: list | None = None) -> np.ndarray:
        """alpha (L + 1, n, K); logp has one more row, of -inf, for no piece."""
        n, length = codes.shape
        alpha = np.zeros((length + 1, n, logp.shape[1]))
        for j, edges in self._columns(codes):
            ways = np.empty((len(edges), n, logp.shape[1]))
            for w, (i, ids) in zip(ways, edges, strict=True):
                np.add(alpha[i], logp[ids], out=w)
            i, ids = edges[-1]  # single characters
            unknown = np.flatnonzero(ids < 0)
            if len(unknown):
                ways[-1, unknown] = alpha[i, unknown] + self._spelled(codes[unknown, j - 1], logp)
            most = ways.max(axis=0)
            ways -= most
            np.exp(ways, out=ways)
            alpha[j] = np.log(ways.sum(axis=0)) + most
            if keep is not None:
                keep.append(edges)
        return alpha

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices and codes of words, begun by the mark, of one length at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(words)], strict=False):
            step = BLOCK if lengths[order[lo]] <= TOGETHER else 1
            for at in range(lo, hi, step):
                own = order[at : min(hi, at + step)]
                text = "".join(words[k] for k in own)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), -1)
                yield own, np.concatenate([np.full((len(own), 1), ord(BEGIN), np.uint32), codes], axis=1)

    def score(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log marginal probabilities (n, K) of words under K models (pieces, K)."""
        out = np.zeros((len(words), logp.shape[1]))
        padded = np.vstack([logp, np.full((1, logp.shape[1]), -np.inf)])
        with np.errstate(over="ignore", divide="ignore"):
            for own, codes in self._groups(words):
                if codes.shape[1] > LONG:
                    for k, word in zip(own, codes, strict=True):
                        out[k] = _Long(self, word, padded).forward()
                else:
                    out[own] = self._forward(codes, padded)[-1]
        return out

    def expected(self, words: list[str], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces, K) over all segmentations; weights (n, K) is how often each word came."""
        k = logp.shape[1]
        total = np.zeros((self.size + 1, k))
        padded = np.vstack([logp, np.full((1, k), -np.inf)])
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for own, codes in self._groups(words):
                if codes.shape[1] > LONG:
                    for w, word in zip(weights[own], codes, strict=True):
                        _Long(self, word, padded).expected(w, total)
                    continue
                keep: list = []
                alpha = self._forward(codes, padded, keep)
                length = codes.shape[1]
                beta = np.full_like(alpha, -np.inf)
                beta[length] = 0
                scale = np.log(weights[own]) - alpha[length]
                found: list[np.ndarray] = []
                shares: list[np.ndarray] = []
                from_: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(length)]
                for j, edges in enumerate(keep, 1):
                    for i, ids in edges:
                        from_[i].append((j, ids))
                for i in range(length - 1, -1, -1):
                    ways = np.empty((len(from_[i]), *beta[i].shape))
                    unknown: np.ndarray | list = []
                    for w, (j, ids) in zip(ways, from_[i], strict=True):
                        np.add(beta[j], padded[ids], out=w)
                        if j == i + 1:  # single characters
                            unknown = np.flatnonzero(ids < 0)
                            if len(unknown):
                                w[unknown] = beta[j, unknown] + self._spelled(codes[unknown, i], padded)
                    most = ways.max(axis=0)
                    most[np.isneginf(most)] = 0
                    ways -= most
                    np.exp(ways, out=ways)
                    beta[i] = np.log(ways.sum(axis=0)) + most
                    ways *= np.exp(alpha[i] + most + scale)
                    for share, (j, ids) in zip(ways, from_[i], strict=True):
                        found.append(ids)
                        shares.append(share)
                        if j == i + 1:
                            for u in unknown:
                                np.add.at(total, self.bytes[list(chr(codes[u, i]).encode("utf-8", "surrogatepass"))], share[u])
                ids, share = np.concatenate(found), np.concatenate(shares)
                ids = np.where(ids < 0, self.size, ids)
                for m in range(k):
                    total[:, m] += np.bincount(ids, weights=share[:, m], minlength=self.size + 1)
        return total[:-1]


class _Long:
    """Both recursions for one very long word, with only a part of the columns held at a time.

    Probabilities are kept as numbers with a running factor taken out every four
    characters, so that a step is one product and one sum. Of the first recursion the
    columns before each part are kept; the second one recomputes a part from them.
    """

    def __init__(self, model: Lattice, codes: np.ndarray, logp: np.ndarray) -> None:
        self.model, self.codes, self.logp, self.most = model, codes, logp, model.longest
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def edges(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """For each end in first..last - 1: ids of the pieces of the longest to one character that end there, and their log weights."""
        m, none = self.most, self.logp.shape[0] - 1
        ids = np.full((last - first, m), none, np.int64)
        c = self.codes.astype(np.uint64) + np.uint64(1)
        h = np.zeros(last - first, np.uint64)
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(m):  # one character more in front
                ends = np.arange(max(first, k), last)
                h[ends - first] += c[ends - k] * power
                power *= _MULTIPLIER
                if len(ends):
                    found = self.model._find(h[ends - first])
                    ids[ends - first, m - 1 - k] = np.where(found < 0, none, found)
        lp = self.logp[ids]
        unknown = np.flatnonzero(ids[:, -1] == none)
        if len(unknown):
            lp[unknown, -1] = self.model._spelled(self.codes[first + unknown], self.logp)
        return ids, lp

    @staticmethod
    def _steps(weights: np.ndarray, start: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """After the columns start, each column is the sum of those before it by weights: the last ones, their log factor, and the logs of all."""
        n, m, k = weights.shape
        out, raw, factor, now = np.zeros((m + n, k)), np.empty((m + n, k)), np.empty((m + n, k)), scale
        out[:m], factor[:m] = start, scale
        raw[:m] = start
        for j in range(n):
            out[m + j] = raw[m + j] = (out[j : m + j] * weights[j]).sum(axis=0)
            factor[m + j] = now
            if j % 4 == 3 or j == n - 1:
                window = out[j + 1 : m + j + 1]
                np.minimum(window / raw[m + j], 1e300, out=window)  # what is more than that above is so far off that no piece reaches across
                now = now + np.log(raw[m + j])
        with np.errstate(divide="ignore"):
            return out[-m:], now, np.log(raw) + factor

    def forward(self, keep: bool = False) -> np.ndarray:
        k = self.logp.shape[1]
        last, scale = np.zeros((self.most, k)), np.zeros(k)
        last[-1] = 1
        for at in range(0, len(self.codes), PART):
            if keep:
                self.kept.append((last, scale))
            _, lp = self.edges(at, min(len(self.codes), at + PART))
            last, scale, _ = self._steps(np.exp(lp), last, scale)
        return np.log(last[-1]) + scale

    def expected(self, weight: np.ndarray, total: np.ndarray) -> None:
        """Adds weight times the expected counts to total (pieces and one more, K)."""
        whole, n, m, k = self.forward(keep=True), len(self.codes), self.most, self.logp.shape[1]
        after, scale = np.zeros((m, k)), np.zeros(k)  # the columns at and after a part's end, in falling order of place
        after[-1] = 1
        with np.errstate(divide="ignore", invalid="ignore"):
            for number in range(len(self.kept) - 1, -1, -1):
                at = number * PART
                stop = min(n, at + PART)
                ids, lp = self.edges(at, min(n, stop + m - 1))
                before = self._steps(np.exp(lp[: stop - at]), *self.kept[number])[2][m - 1 : m - 1 + stop - at]
                # edges by their start: the one of length x from i ends in column i + x
                start, length = np.arange(stop - at)[:, None], np.arange(m, 0, -1)[None, :]
                end = start + length - 1
                inside = end < len(ids)
                end = np.minimum(end, len(ids) - 1)
                own_ids = np.where(inside, ids[end, m - length], len(total) - 1)
                own_lp = np.where(inside[:, :, None], lp[end, m - length], -np.inf)
                after, scale, logs = self._steps(np.exp(own_lp[::-1]), after, scale)
                # logs turned round: from the part's start on, then the m - 1 columns after its end
                share = np.where(own_lp > -np.inf, np.exp(before[:, None, :] + own_lp + logs[::-1][start + length] - whole) * weight, 0)
                for c in range(k):
                    total[:, c] += np.bincount(own_ids.ravel(), weights=share[:, :, c].ravel(), minlength=len(total))
                for i in np.flatnonzero(own_ids[:, -1] == len(total) - 1).tolist():  # spelled by bytes
                    np.add.at(total, self.model.bytes[list(chr(self.codes[at + i]).encode("utf-8", "surrogatepass"))], share[i, -1])


def normalised(counts: np.ndarray, smooth: float) -> np.ndarray:
    """Log probabilities (pieces, K) of counts with additive smoothing."""
    c = counts + smooth
    return np.log(c / c.sum(axis=0))


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One for each worker process and vocabulary."""
    return Lattice(path)


def gathered(frames: Iterator[pd.DataFrame], rows: int = 120_000) -> Iterator[pd.DataFrame]:
    """Frames joined until they have so many rows: words of one length are then many enough to be worth an array."""
    for held in chunks(frames, len, rows):
        yield pd.concat(held, ignore_index=True)


def chunks(items: Iterable, size: callable, most: int) -> Iterator[list]:
    """items in lists of about most by size."""
    held, total = [], 0
    for x in items:
        held.append(x)
        total += size(x)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held
