"""SentencePiece encoding and decoding that keeps offsets.

The text is normalised by longest-prefix matching in the model's compiled
character map, and every byte made by a match remembers the source bytes it
came from. The library's pieces cover the normalised bytes one after the other,
so their lengths project each piece to a span of bytes of the original text.

Defined cases: a null text counts as empty and gives the begin and end ids
only; white space at the ends, tabs and line breaks follow the model's own
settings; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, map_texts

SPACE = "▁".encode()
"""The model's mark for a space: a fixed value of the format."""


def read_character_map(blob: bytes) -> dict[bytes, bytes]:
    """Every source string of a compiled character map with its replacement.

    The map is a double-array trie in 32-bit units, preceded by its size in
    bytes and followed by the replacements, each ended by a zero byte.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4:4 + size], "<u4"), blob[4 + size:]
    found: dict[bytes, bytes] = {}
    # a unit keeps the byte that leads to it, whether a value ends there, and the way to its children
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    todo, every = [(0, b"")], np.arange(1, 256)
    while todo:
        node, prefix = todo.pop()
        base = node ^ offset(int(units[node]))
        if prefix and (int(units[node]) >> 8) & 1:
            at = int(units[base]) & 0x7FFFFFFF
            found[prefix] = texts[at:texts.index(b"\0", at)]
        child = base ^ every
        child = child[child < len(units)]
        for c in child[(units[child] & 0x800000FF) == (base ^ child)].tolist():
            todo.append((c, prefix + bytes([base ^ c])))
    return found


class Aligner:
    """Normalises a text as the model does and remembers where every byte came from."""

    def __init__(self, spec) -> None:
        self.map = read_character_map(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        # the lengths of the keys that begin with a byte, longest first, so that a match is the longest prefix in the map
        lengths: dict[int, set[int]] = {}
        for key in self.map:
            lengths.setdefault(key[0], set()).add(len(key))
        self.lengths = {byte: sorted(found, reverse=True) for byte, found in lengths.items()}
        self.first = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(lengths)) + b"]") if lengths else None

    def chunks(self, raw: bytes) -> list[tuple[bytes, int, int]]:
        """Runs (bytes, begin, end): copied byte by byte, or made by a match from all of its source."""
        out, at, look = [], 0, 0
        while self.first and (m := self.first.search(raw, look)):
            i = m.start()
            key = next((k for n in self.lengths[raw[i]] if (k := raw[i:i + n]) in self.map), None)
            if key is None:
                look = i + 1  # keys begin where characters do, so no match begins inside this one
                continue
            if i > at:
                out.append((raw[at:i], at, i))
            at = look = i + len(key)
            out.append((self.map[key], i, at))
        if at < len(raw):
            out.append((raw[at:], at, len(raw)))
        return out

    def align(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and the source bytes [begin, end) of each."""
        parts, begins, ends = [], [], []
        at = 0
        for made, begin, end in self.chunks(raw):
            parts.append(made)
            if made == raw[begin:end]:
                begins.append(np.arange(begin, end))
                ends.append(np.arange(begin + 1, end + 1))
            else:
                begins.append(np.full(len(made), begin))
                ends.append(np.full(len(made), end))
            at = end
        text = b"".join(parts)
        begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        codes = np.frombuffer(text, np.uint8)
        if self.trim:
            space = codes == 32
            keep = ~(space & np.concatenate(([True], space[:-1])))  # the first of a run, none at the front
            if len(keep) and space[-1]:
                keep[len(text.rstrip(b" ")):] = False
            codes, begin, end = codes[keep], begin[keep], end[keep]
        if self.prefix and len(codes):
            codes, begin, end = np.concatenate(([32], codes)), np.concatenate((begin[:1], begin)), np.concatenate((begin[:1], end))
        if self.escape:
            times = np.where(codes == 32, len(SPACE), 1)
            begin, end = np.repeat(begin, times), np.repeat(end, times)
            return codes.astype(np.uint8).tobytes().replace(b" ", SPACE), begin, end
        return codes.astype(np.uint8).tobytes(), begin, end


def aligned_encoder(path: str):
    """A function text -> (ids, begin bytes, end bytes); the outer ids have empty spans."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = proto.ModelProto.FromString(model.serialized_model_proto())
    aligner = Aligner(spec.normalizer_spec)
    lengths = np.array([1 if p.type == p.BYTE else 0 if p.type == p.CONTROL else len(p.piece.encode()) for p in spec.pieces])
    unknown = model.unk_id()

    def encode(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = text.encode()
        ids = np.array(model.encode(text, num_threads=1), np.int64)
        made, begin, end = aligner.align(raw)
        size = lengths[ids] if len(ids) else np.zeros(0, np.int64)
        if (ids == unknown).any():  # an unknown piece is as long as the library says
            pieces = model.encode(text, return_type="proto").pieces
            size = np.array([len(p.piece.encode()) for p in pieces])
        last = np.cumsum(size)
        if (last[-1] if len(last) else 0) != len(made):
            raise ValueError("pieces do not cover the normalised text")
        first = last - size
        spans = (begin[first], end[last - 1]) if len(ids) else (first, last)
        outer = (model.bos_id(), model.eos_id())
        return (np.concatenate((outer[:1], ids, outer[1:])), np.concatenate(([0], spans[0], [len(raw)])),
                np.concatenate(([0], spans[1], [len(raw)])))

    return model, encode


def encode_pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids of every text with begin and end ids, and the span of original UTF-8 bytes of each."""

    def make():
        _, encode = aligned_encoder(path)

        def work(texts):
            made = [encode(t or "") for t in texts]
            return [[m[i] for m in made] for i in range(3)]

        return work

    return map_texts(docs.select(key, text), text, make, "ids array<int>, begins array<int>, ends array<int>")


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The texts of arrays of ids, as the library decodes them, in the column ``decoded``."""
    @F.pandas_udf("string")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for part in parts:
            yield part.map(lambda x: None if x is None else model.decode(x.tolist()))

    return encoded.withColumn("decoded", decoded(ids))


def piece_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every text; keep counts and digests of ids, spans and decoded text."""

    def make():
        model, encode = aligned_encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def work(texts):
            out = [[], [], [], [], []]
            for t in texts:
                ids, begins, ends = encode(t or "")
                out[0].append(len(ids))
                out[1].append(sha(ids.astype("<u4").tobytes()))
                out[2].append(sha(model.decode(ids.tolist()).encode()))
                out[3].append(sha(np.stack((begins, ends), 1).astype("<u4").tobytes()))
                out[4].append(int((ends > begins).sum()))
            return out

        return work

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_spans long"
    return map_texts(docs.select(key, text), text, make, fields)


def op1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Held against the library's own ids, offsets and decoded texts in tests."""
    import public_tokenizers

    return piece_digests(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))
