"""Token ids of texts with a lower-casing word tokenizer that drops white space.

Such a tokenizer gives a text the ids of its words, one after another, so each distinct word
is encoded once and the rest is a gather. Words of Latin-1 letters, digits and ASCII marks go
straight to the library's BPE model in the pieces its pattern makes of them; any other word
goes through the library's whole chain. tests/llm compares both with whole-text encoding.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow_text import ascii_words, ranges, starts_of, strings_of, utf8_views

#: Distinct words a task remembers; beyond it the memory starts anew, results stay the same.
MEMORY = 400_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"[{LETTERS}0-9{MARKS}]+")
PIECES = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids, and if asked the code points each token covers, for arrays of texts."""

    def __init__(self, tokenizer_file: str, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spans, self.memory, self.pieces = Tokenizer.from_file(tokenizer_file), spans, {}, {}
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def _piece(self, piece: str):
        """Ids of a piece as bytes; with spans also the code points (start, end) of each token in it."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) > MEMORY:
                self.pieces.clear()
            low = piece.lower()
            tokens = self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))
            found = array(self.code, [t.id for t in tokens]).tobytes()
            if self.spans:
                owner = [k for k, c in enumerate(low) for _ in range(len(c.encode()))]
                at, spans = 0, []
                for t in tokens:
                    n = len(t.value.removesuffix("</w>"))
                    spans += (owner[at], owner[at + n - 1] + 1)
                    at += n
                found = (found, array("I", spans).tobytes())
            self.pieces[piece] = found
        return found

    def _word(self, word: str):
        if not self.spans and word.isascii() and word.isalpha():
            return array(self.code, [t.id for t in self.model.tokenize(word.lower())]).tobytes()
        if PLAIN.fullmatch(word) and "<|" not in word:
            if not self.spans:
                return b"".join(map(self._piece, PIECES.findall(word)))
            ids, spans = [], []
            for m in PIECES.finditer(word):
                piece = self._piece(m[0])
                ids.append(piece[0])
                spans.append((np.frombuffer(piece[1], "<u4") + np.uint32(m.start())).tobytes())
            return b"".join(ids), b"".join(spans)
        e = self.tokenizer.encode(word, add_special_tokens=False)
        ids = np.array(e.ids, self.dtype).tobytes()
        return (ids, np.array(e.offsets, "<u4").tobytes()) if self.spans else ids

    def _known(self, words: list[str]) -> list:
        if len(self.memory) > MEMORY:
            self.memory.clear()
        memory, out = self.memory, []
        for w in words:
            found = memory.get(w)
            if found is None:
                found = memory[w] = self._word(w)
            out.append(found)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text."""
        words, per_text = ascii_words(parted(texts))
        coded = words.dictionary_encode()
        codes, found = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), self._known(strings_of(coded.dictionary))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        lengths = size[codes]
        ids = flat[ranges(starts_of(size)[:-1][codes], lengths)]
        tokens = starts_of(lengths)
        at = starts_of(per_text)
        return ids, tokens[at[1:]] - tokens[at[:-1]]


#: 1: ASCII letters; 2: ASCII marks but the apostrophe; 0: other bytes.
KIND = np.array([1 if chr(b).isalpha() and b < 128 else 2 if 32 < b < 127 and b != 39 and not chr(b).isdigit() else 0 for b in range(256)], np.uint8)


def parted(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and a space where an ASCII letter meets a mark.

    The tokenizer parts them there anyway and drops white space, so the ids stay, and there are
    far fewer distinct words. Texts that may hold a special token's string stay as they are.
    """
    offsets, data = utf8_views(texts)
    low = int(offsets[0])
    data = data[low : int(offsets[-1])]
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    kind = KIND[data]
    pair = kind[:-1] * 4 + kind[1:]
    at = np.flatnonzero((pair == 6) | (pair == 9)) + 1
    spaced = np.insert(data, at, 32)
    offsets = offsets - low
    offsets = offsets + np.searchsorted(at, offsets, side="left")
    out = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(spaced))
    return pc.ascii_lower(out)


@lru_cache(2)
def word_encoder(tokenizer_file: str, spans: bool = False) -> WordEncoder:
    """One encoder a worker process: tasks that run after one another share what it remembers."""
    return WordEncoder(tokenizer_file, spans)
