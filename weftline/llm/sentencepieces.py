"""Offset-preserving SentencePiece encoding and decoding.

Normalisation goes by longest prefix through the model's compiled character map (a Darts double
array followed by replacement strings) and records, for every normalised byte, the byte of the
source that it came from; models without a map (identity) need only the white-space rules. The
library segments the text; its pieces, laid end to end, spell the normalised text, so a running sum
of piece lengths projected through the alignment gives each piece's span in the source bytes.

Defined cases: null and empty texts give no ids, no spans and an empty decoded text; texts of any
length are encoded whole; other columns pass through unless they are named like an output column,
in which case the output replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

SPACE = "▁".encode()


class CharacterMap:
    """Longest-prefix rewriting by a compiled character map: 4 bytes of trie size, trie, strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes eaten, replacement) of the longest rule that is a prefix of data[at:]."""
        units, found = self.units, None
        node = self._child(0)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if c == 0 or node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != c:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found

    def _offset(self, unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def _child(self, node: int) -> int:
        return node ^ self._offset(self.units[node])


class Encoder:
    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        spec = proto.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        n = spec.normalizer_spec
        self.map = CharacterMap(n.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        kinds = proto.ModelProto.SentencePiece.Type
        self.byte = np.array([p.type == kinds.BYTE for p in spec.pieces])
        self.unknown = np.array([p.type == kinds.UNKNOWN for p in spec.pieces])
        pieces = [p.piece.encode() for p in spec.pieces]
        self.width = np.array([1 if b else len(p) for b, p in zip(self.byte, pieces, strict=True)], np.int64)
        self.spaces = np.array([0 if b else p.count(SPACE) for b, p in zip(self.byte, pieces, strict=True)], np.int64)
        self.plain = not self.map.units and not self.squeeze and self.escape

    def normalise(self, source: bytes) -> tuple[bytes, list[int]]:
        """Normalised bytes and, for each and the end, the source byte it stands for."""
        out, align, at = bytearray(), [], 0
        mark = SPACE if self.escape else b" "
        if self.squeeze:
            while at < len(source) and self._step(source, at)[1] == b" ":
                at += self._step(source, at)[0]
        if self.dummy and at < len(source):
            out += mark
            align += [at] * len(mark)
        blank = self.squeeze
        while at < len(source):
            eaten, put = self._step(source, at)
            if self.squeeze:
                while blank and put.startswith(b" "):
                    put = put[1:]
                blank = put.endswith(b" ") if put else blank
            put = put.replace(b" ", mark)
            out += put
            align += [at] * len(put)
            at += eaten
        end = len(source)
        if self.squeeze:
            while out.endswith(mark):
                end = align[len(out) - len(mark)]
                del out[-len(mark) :], align[-len(mark) :]
        return bytes(out), [*align, end]

    def _step(self, source: bytes, at: int) -> tuple[int, bytes]:
        if self.map.units and (hit := self.map.longest(source, at)):
            return hit
        b = source[at]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return n, source[at : at + n]

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Source byte where each piece begins; the last entry is where the last one ends."""
        source = text.encode()
        if self.plain and not self.unknown[ids].any() and SPACE not in source:
            # every mark is one space of the source but for the leading dummy, which is none
            steps = np.cumsum(self.width[ids] - (len(SPACE) - 1) * self.spaces[ids]) - bool(self.dummy)
            return np.concatenate([[0], np.clip(steps, 0, len(source))])
        norm, align = self.normalise(source)
        if self.unknown[ids].any():
            surfaces = [len(p.surface.encode()) for p in self.library.encode(text, out_type="immutable_proto").pieces]
            ends = [p.end for p in self.library.encode(text, out_type="immutable_proto").pieces]
            return np.array([0, *(len(text[:e].encode()) for e in ends)]) if surfaces else np.zeros(1, np.int64)
        return np.asarray(align)[np.concatenate([[0], np.clip(np.cumsum(self.width[ids]), 0, len(norm))])]


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def encode(df: DataFrame, model: str, text_col: str = "text", chunk: int = 256) -> DataFrame:
    """``df`` with ids array<int>, starts and ends array<int> (source bytes), decoded string.

    ``model`` is a path that every executor can open (the tokenizer is part of its environment)."""
    kept = [c for c in df.columns if c not in ("ids", "starts", "ends", "decoded")]
    frame = df.select(*kept)
    names, text_at = frame.columns, frame.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                part = batch.slice(lo, chunk)
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                ids = e.library.encode(texts, num_threads=1)
                decoded = e.library.decode(ids) if ids else []
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                starts, ends = [], []
                for t, x in zip(texts, ids, strict=True):
                    s = e.spans(t, np.asarray(x, np.int64)).astype(np.int32)
                    starts.append(s[:-1])
                    ends.append(s[1:])
                flat = lambda arrays: pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(arrays).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat([np.asarray(x, np.int32) for x in ids]), flat(starts), flat(ends), pa.array(decoded, pa.string())], names=[*names, "ids", "starts", "ends", "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(tidy(run), f"{fields}, ids array<int>, starts array<int>, ends array<int>, decoded string")
