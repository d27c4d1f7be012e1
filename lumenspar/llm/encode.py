"""Token ids of a tokenizer file, as the tokenizers library gives them, but faster.

Byte-level BPE files take a quick path: a text without two spaces in a row falls apart
at its spaces without any change to the ids, so each stretch is encoded once and then
looked up. All else (other kinds of tokenizer, texts with double spaces or with the
string of an added token) goes through an engine that sees the whole text.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

#: Entries of a lookup table before it starts anew; some 150 bytes each.
CACHE = 1_000_000
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Lookup(dict):
    """Stretch without a space -> bytes of its ids, after ``prefix``.

    A stretch that is not known yet is cut further where the pattern cuts for certain:
    around a single line end between other characters, and before a last full stop or
    comma after letters. Letters alone are one piece and skip the pattern.
    """

    def __init__(self, core, prefix: str, inner: _Lookup | None = None):
        super().__init__()
        self.core, self.prefix, self.inner = core, prefix, self if inner is None else inner

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        head, line_end, tail = stretch.partition("\n")
        if stretch.isalpha():
            out = array("I", self.core.encode_single_piece((self.prefix + stretch).encode())).tobytes()
        elif line_end and head and tail and not head[-1].isspace() and not tail[0].isspace():
            out = self[head] + self.inner["\n"] + self.inner[tail]
            return out  # made of known parts; not worth a place
        elif stretch[-1:] in (".", ",") and stretch[:-1].isalpha():
            return self[stretch[:-1]] + self.inner[stretch[-1]]
        else:
            out = array("I", self.core.encode_ordinary(self.prefix + stretch)).tobytes()
        if len(stretch) < 64:
            self[stretch] = out
        return out


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit bytes, no tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = self._ranks(spec)
        self.engine = None
        if ranks:
            import tiktoken

            self.engine = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.first = _Lookup(self.engine, "")
            self.later = _Lookup(self.engine, " ", self.first)

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """Ranks of a byte-level BPE whose ids follow its merges; None for other files."""
        model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        byte, vocab = _byte_of(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        base = len(vocab) - len(merges) - sum(t in vocab for t in (a["content"] for a in spec.get("added_tokens", [])))
        if base != 256 or any(vocab.get(a + b) != base + i for i, (a, b) in enumerate(merges)):
            return None
        return {bytes(byte[c] for c in token): rank for token, rank in vocab.items() if rank < base + len(merges)}

    def encode(self, text: str) -> bytes:
        if self.engine is None or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text:
            return np.array(self.engine.encode_ordinary(text), "<u4").tobytes()
        first, *later = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, later))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
