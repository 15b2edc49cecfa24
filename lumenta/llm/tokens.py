"""Token ids of a public byte-level BPE, the vocabulary file being a parameter."""

from __future__ import annotations

import functools
import json

import numpy as np

#: How byte-level BPE splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Latin-1 bytes whose class no Unicode version disputes: they may take the quick way.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0xA1, 0x100)])


def vocabulary() -> str:
    """The default vocabulary's path on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as uint32 arrays; special tokens' strings are ordinary text.

    Both libraries hold the same vocabulary and give the same ids. The quicker one takes
    texts of plain Latin-1, where no version of Unicode's tables can make a difference.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {x["content"] for x in data["added_tokens"]}
        to_byte = _byte_alphabet()
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in data["model"]["vocab"].items() if piece not in special}
        self.quick = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            plain = False
        if plain:
            return np.asarray(self.quick.encode_ordinary(text), np.uint32)
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path)
