"""SentencePiece encoding that keeps, for every piece, its byte span in the original text.

The text is normalised first: at each place the longest prefix that the model's
compiled character map knows is replaced, white space is treated as the model says,
and every byte of the result remembers the byte of the source that it came from.
The library then segments what was normalised here, under the same model with its own normalising switched off;
the surface of the pieces adds up to the normalised text, so each piece is projected back through the alignment and its span
is exact whatever was replaced.

Null texts count as empty and give no pieces. Empty tables give no rows. Repeated rows are encoded alike, extra
columns are ignored, whatever their names, and very long texts are encoded whole. Of prefixes of one length there is only one in a map.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from quern.llm import textpack as tp

MARK = "▁"


class CharsMap:
    """The compiled character map of a model: a double-array trie and its replacement strings."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.strings = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``text[at:]``."""
        if not self.units:
            return None
        units, found = self.units, None
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Normalizer:
    def __init__(self, spec):
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.identity = not self.map.units and not self.squeeze

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text with space marks, and for each of its bytes (and its end) the place in ``text``."""
        mark = MARK.encode()
        if self.identity:
            # No byte is replaced but spaces, each by the three bytes of a mark.
            align = np.repeat(np.arange(len(text)), np.where(np.frombuffer(text, np.uint8) == 32, 3, 1))
            head = [0] * 3 if self.dummy and text else []
            return mark * bool(head) + text.replace(b" ", mark), np.concatenate([head, align, [len(text)]]).astype(np.int64)
        out, align, at = bytearray(), [], 0

        def put(piece: bytes, start: int, length: int) -> None:
            same = len(piece) == length
            out.extend(piece)
            align.extend(start + i if same else start for i in range(len(piece)))

        while at < len(text):
            if hit := self.map.longest(text, at):
                size, new = hit
            else:
                size = next(n for low, n in ((0xF0, 4), (0xE0, 3), (0xC0, 2), (0, 1)) if text[at] >= low)
                new = text[at : at + size]
            if new == b" " or b" " in new:
                for i, part in enumerate(new.split(b" ")):
                    if i and not (self.squeeze and (not out or out.endswith(mark))):
                        put(mark, at, 0)
                    put(part, at, 0)
            else:
                put(new, at, size)
            at += size
        end = len(text)
        while self.squeeze and out.endswith(mark):
            end = align[-1]
            del out[-3:], align[-3:]
        if self.dummy and out:
            out[:0], align[:0] = mark, [align[0]] * 3
        return bytes(out), np.array([*align, end], np.int64)


class Coder:
    """A model: the normaliser says what each byte came from, the library segments what it made."""

    def __init__(self, model: bytes):
        proto = model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalize = Normalizer(proto.normalizer_spec)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        #: The same model for texts that are normalised already.
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        raw = [b"?" if p.type == 6 else p.piece.encode() for p in proto.pieces]
        self.norm_bytes = np.array([len(x) for x in raw], np.int64)
        self.vocabulary = len(raw)
        self.numerals = [str(i) for i in range(len(raw))]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[np.ndarray]]:
        """Ids of each text, and for each byte of what it was normalised to (and its end) the place in the text."""
        made = [self.normalize(t.encode()) for t in texts]
        return self.plain.encode([x.decode() for x, _ in made], num_threads=1), [align for _, align in made]

    def spans(self, ids: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every piece in the bytes of the original text."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.cumsum(self.norm_bytes[ids])
        return align[np.concatenate([[0], end[:-1]])], align[end]


_coders: dict[int, Coder] = {}


def coder(model: Broadcast) -> Coder:
    """One coder for each Python worker and model."""
    key = hash(model.value)
    if key not in _coders:
        _coders[key] = Coder(model.value)
    return _coders[key]


def _encode(model: Broadcast, spans: bool, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model)
        for batch in batches:
            for part in tp.slices(batch, "text", 1 << 20):
                source = [t or "" for t in part["text"].to_pylist()]
                ids, aligned = code.encode(source)
                back = code.sp.decode(ids, num_threads=1)
                sizes = [len(x) for x in ids]
                joined = [hashlib.sha256(",".join(map(code.numerals.__getitem__, x)).encode()).hexdigest() for x in ids]
                cols = [part["doc_id"], pa.array(sizes, pa.int64()), pa.array(joined, pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if spans:
                    flat = [np.array(x, np.int64) for x in ids]
                    pairs = [code.spans(x, align) for x, align in zip(flat, aligned, strict=True)]
                    cut = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    for name, lists in (("ids", flat), ("begins", [x for x, _ in pairs]), ("ends", [y for _, y in pairs])):
                        cols.append(pa.ListArray.from_arrays(cut, pa.array(np.concatenate(lists).astype(np.int32))))
                        names.append(name)
                if texts:
                    cols.append(pa.array(back, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def load(docs: DataFrame, model_path: str) -> Broadcast:
    """The model file (half a megabyte or so, whatever the corpus) for every executor."""
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, spans: bool = True, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of ids and decoded text; with ``spans`` ids, begins and ends; with ``texts`` decoded."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, begins array<int>, ends array<int>" * spans + ", decoded string" * texts
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tp.task(_encode(load(docs, model_path), spans, texts)), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Decodes the ``ids`` of :func:`encode` into ``decoded``."""
    model = load(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = coder(model).sp
        for batch in batches:
            texts = sp.decode([x or [] for x in batch["ids"].to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tp.task(run), "doc_id bigint, decoded string")
