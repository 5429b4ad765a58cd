"""Token ids with the tokenizers library, each distinct word encoded once per worker.

The files' pre-tokenizers never let a token cross from a run of letters into what isn't a letter, nor, in a text in
normal form, depend on more than that. So a text's ids are the ids of its chunks (letter runs, and what stands
between) put together, and only chunks that a worker hasn't met go to the tokenizer. Texts outside these conditions
are encoded whole, and so are those that hold the string of a special token, which gives that token's id as the
library does by default (literal_specials: the ids of ordinary text). Files with any other pre-tokenizer or normalizer
are left to the library throughout.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Chunks that a worker remembers (about 350 MB); beyond it, it starts anew.
REMEMBERED = 3 << 19
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # without the one capital whose small form isn't a single letter
#: Letters and the space before them; a line feed between words; what else stands without white space within.
_SPACED = re.compile(rf" ?[{_LETTERS}]++(?!\w)|\n(?=\S)|\s*+\S+|\s+")
_UNSPACED = re.compile(rf"[{_LETTERS}]++(?!\w)|\S+")
_ODD = re.compile("[\x1c-\x1f]")
#: A full stop or comma beside other marks makes one piece with them.
_MARKS = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")
_WORD = re.compile(rf" ?[{_LETTERS}]+")


#: What the two kinds of files that chunks serve do to a text before its merges.
_FORMS = (
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
)


def _known_form(form: dict) -> bool:
    return form["model"]["type"] == "BPE" and (form["normalizer"], form["pre_tokenizer"]) in _FORMS


@lru_cache(1)
def _byte_table() -> dict[int, int]:
    """Byte-level files write each byte as one letter: printable ones as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


def _byte_letters(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(_byte_table())


_LINE = _byte_letters("\n")


class Encoder:
    """Ids of texts, as little-endian bytes of .dtype."""

    def __init__(self, path: str, literal_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        form = json.loads(self.tokenizer.to_str())
        self.by_chunks = _known_form(form)
        specials = [re.escape(t["content"]) for t in form["added_tokens"] if not (literal_specials and t["special"])]
        self.specials = re.compile("|".join(specials) or r"(?!)", re.I)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        # byte-level ids keep white space, the others drop it
        self.spaced = self._ids("a b") != self._ids("a") + self._ids("b")
        self.chunks = (_SPACED if self.spaced else _UNSPACED).findall
        self.lower = self._ids("AÉ") == self._ids("aé")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > REMEMBERED:
            self.known.clear()
        words = list(filter(_WORD.fullmatch, chunks))
        code, tokenize, known = "H" if self.dtype.itemsize == 2 else "I", self.tokenizer.model.tokenize, self.known
        # a letter run, with a space before it or not, is one piece for the model
        joined = "\n".join(words)
        pieces = _byte_letters(joined.lower() if self.lower else joined).split(_LINE) if words else []
        for c, piece in zip(words, pieces, strict=True):
            known[c] = array(code, [t.id for t in tokenize(piece)]).tobytes()
        others = set(chunks).difference(words)
        for c, x in zip(others, self.tokenizer.encode_batch(list(others), add_special_tokens=False), strict=True):
            known[c] = array(code, x.ids).tobytes()

    def _chunks(self, text: str) -> list[str]:
        """Consecutive chunks; where single marks stand between words, plain replacement cuts like the pattern."""
        if not self.spaced:
            if "Σ" in text or "İ" in text:  # their small forms depend on what follows, or aren't one letter
                return self.chunks(text)
            text = text.lower() if self.lower else text
            if not _MARKS.search(text):
                return text.replace(".", " . ").replace(",", " , ").split()
        return self.chunks(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.by_chunks or _ODD.search(text) or self.specials.search(text) or not unicodedata.is_normalized("NFC", text):
                out.append(np.array(self._ids(text), self.dtype).tobytes())
            else:
                chunks = self._chunks(text)
                ids = list(map(self.known.get, chunks))
                if None in ids:
                    self._learn(list({c for c, x in zip(chunks, ids, strict=True) if x is None}))
                    ids = [x if x is not None else self.known[c] for c, x in zip(chunks, ids, strict=True)]
                out.append(b"".join(ids))
        return out


@lru_cache(4)
def encoder(path: str, literal_specials: bool = False) -> Encoder:
    """One encoder for each file and worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, literal_specials)


def vocabulary_path(name: str) -> str:
    """The place of one of the public vocabulary files on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
