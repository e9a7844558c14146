"""Operator 6: SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The automaton of all pieces reads a chunk once; at each end its output links give every piece
that ends there, and each relaxes the best way to that place:

* unigram models: the way with the highest sum of scores;
* byte-pair models: the only way that merging would give. A segmentation is the one merges give
  exactly if each pair of neighbours is (it merges back to those two pieces, a fact remembered
  by pair), so "best" is "may follow the last piece of the way so far".

Characters without a piece become bytes and end a run. No piece has a space inside, so a text
falls into chunks (spaces and the run after them) that are encoded once each and remembered.

Nulls: a null or empty text has no ids. Repeated rows give a row each; no rows give none.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ranges, starts_of, strings_of, text_slices, texts_of, utf8_views

SPACE = "▁"
#: Distinct chunks, and pairs of pieces, that a task remembers; beyond it the memory starts anew.
MEMORY, PAIRS = 300_000, 1_000_000


class PieceModel:
    """Encoder and decoder of a SentencePiece model with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        lib = self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        self.score = [lib.get_score(i) for i in range(n)]
        self.id = {self.piece[i]: i for i in plain}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if any(SPACE in self.piece[i].lstrip(SPACE) for i in plain) or any("\n" in self.piece[i] for i in plain) or len(self.byte) != 256:
            raise ValueError("a piece with a space or line end inside, or no byte pieces")
        self.single = {p for p in self.id if len(p) == 1}
        self.spanned = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.merges = self._merges(model_file)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}
        spelled = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = starts_of(self.spelled_size)[:-1]
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])

    @staticmethod
    def _merges(model_file: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        return proto.trainer_spec.model_type == pb.TrainerSpec.BPE

    def _merged(self, text: str) -> list[str]:
        """What merging gives: the best-scored neighbours join, leftmost first, until none can."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for k, (a, b) in enumerate(zip(parts, parts[1:])):
                i = self.id.get(a + b)
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _may_follow(self, last: int, i: int) -> bool:
        """Whether piece i can stand after piece `last` (-1: at the start of a run)."""
        key = (last + 1 << 20) | i
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            want = [self.piece[i]] if last < 0 else [self.piece[last], self.piece[i]]
            known = self.pairs[key] = self._merged("".join(want)) == want
        return known

    def _run(self, run: str) -> list[int]:
        """Ids of characters that all have pieces: one pass over the automaton's outputs."""
        n = len(run)
        came = [-1] * (n + 1)
        if self.merges:
            follow, pairs = self._may_follow, self.pairs
            for end, (size, i) in self.automaton.iter(run):
                start = end + 1 - size
                last = came[start]
                if start and last < 0:
                    continue
                known = pairs.get((last + 1 << 20) | i)
                if known or known is None and follow(last, i):
                    came[end + 1] = i
        else:
            best = [0.0] + [float("-inf")] * n
            for end, (size, i) in self.automaton.iter(run):
                score = best[end + 1 - size] + self.score[i]
                if score > best[end + 1]:
                    best[end + 1], came[end + 1] = score, i
        ids, at = [], n
        while at:
            ids.append(came[at])
            at -= len(self.piece[came[at]])
        return ids[::-1]

    def _chunk(self, chunk: str) -> bytes:
        if self.single.issuperset(chunk):
            return array("H", self._run(chunk)).tobytes()
        if "\n" in chunk and len(chunk) > 1:
            lines = chunk.split("\n")
            end = array("H", [self.byte[10]]).tobytes()
            return end.join(self._known(x) if x else b"" for x in lines)
        ids, run = [], ""
        for c in chunk:
            if c in self.single:
                run += c
                continue
            ids += self._run(run) if run else []
            ids += [self.byte[b] for b in c.encode()]
            run = ""
        return array("H", ids + (self._run(run) if run else [])).tobytes()

    def _known(self, chunk: str) -> bytes:
        found = self.memory.get(chunk)
        if found is None:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            head = chunk[:-1]
            if len(chunk) > 2 and chunk[-2:] not in self.spanned:  # no piece spans the last two characters
                found = (self.memory.get(head) or self._chunk(head)) + self._chunk(chunk[-1])
                self.memory[head] = found[: -len(self._chunk(chunk[-1]))]
            else:
                found = self._chunk(chunk)
            self.memory[chunk] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (u2), and the number of ids of each text."""
        texts = pc.replace_substring(texts, SPACE, " ")
        split = pc.split_pattern(texts, " ")
        items, per_text = pc.list_flatten(split), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.equal(pc.binary_length(items), 0).to_numpy(zero_copy_only=False)
        at = starts_of(per_text)
        last = np.zeros(len(blank), bool)
        last[at[1:] - 1] = True
        keep = ~blank | last
        if len(texts):  # a text of no characters has no chunk
            keep[at[:-1][pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)]] = False
        kept = np.flatnonzero(keep)
        previous = np.maximum(np.concatenate(([-1], kept[:-1])), np.repeat(at[:-1], per_text)[kept] - 1) if len(kept) else kept
        spaces = kept - previous  # of each chunk, the one before the text's first character included
        coded = items.take(pa.array(kept)).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = strings_of(coded.dictionary)
        many = np.flatnonzero(spaces > 1)
        if len(many):
            extra: dict[tuple[int, int], int] = {}
            for k in many.tolist():
                codes[k] = extra.setdefault((int(codes[k]), int(spaces[k])), len(words) + len(extra))
            chunks = [SPACE + w for w in words] + [SPACE * s + words[c] for c, s in extra]
        else:
            chunks = [SPACE + w for w in words]
        found = [self._known(c) for c in chunks]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat = np.frombuffer(b"".join(found), "<u2")
        lengths = size[codes]
        ids = flat[ranges(starts_of(size)[:-1][codes], lengths)]
        tokens, chunk_at = starts_of(lengths), starts_of(keep.astype(np.int64))
        return ids, tokens[chunk_at[at[1:]]] - tokens[chunk_at[at[:-1]]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of flat ids: bytes of the pieces, less the space before the first character."""
        ids = ids.astype(np.int64)
        size = self.spelled_size[ids]
        data = self.spelled[ranges(self.spelled_at[ids], size)]
        ends = starts_of(size)[starts_of(counts)]
        keep = np.ones(len(data), bool)
        keep[ends[:-1][ends[1:] > ends[:-1]]] = False
        sizes = np.diff(ends) - (ends[1:] > ends[:-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(starts_of(sizes)), pa.py_buffer(np.ascontiguousarray(data[keep]))])


@lru_cache(2)
def piece_model(model_file: str) -> PieceModel:
    """One model a worker process."""
    return PieceModel(model_file)


def piece_ids(docs: DataFrame, model_file: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, n_bytes (tokens that spell a byte), ids_crc32 (ids as
    little-endian u32), n_decoded (bytes of the decoded text), decodes (whether it is the text,
    the space sign read as a space); with_ids: also ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for part in text_slices(batches):
            texts = texts_of(part)
            ids, counts = model.encode(texts)
            at = starts_of(counts)
            back = model.decode(ids, counts)
            same = pc.equal(back, pc.replace_substring(texts, SPACE, " ").cast(pa.large_binary()))
            wide = ids.astype("<u4")
            spelled = starts_of(model.is_byte[ids])
            columns = {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array(counts),
                "n_bytes": pa.array(spelled[at[1:]] - spelled[at[:-1]]),
                "ids_crc32": pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])], pa.int64()),
                "n_decoded": pc.binary_length(back).cast(pa.int64()),
                "decodes": same,
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(wide.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, n_decoded long, decodes boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)
