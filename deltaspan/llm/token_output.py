"""Token ids in patched frame-of-reference blocks.

A segment is the binary image of a run of documents in ascending id order:

    header   4s magic, u32 version, u32 block size, u64 documents, u64 ids, u32 blocks
    lengths  u32 for each document (its ids with the end id)
    index    u64 for each block: where it starts, counted from the end of the index
    blocks   u32 minimum, u8 width, u8 exception width, u16 values, u16 exceptions,
             the packed low bits of (value - minimum), u16 places of the
             exceptions and their packed high bits

Each block packs at the width that a percentile of its values needs; the values
beyond keep their low bits in place and their high bits in the exception list.
Any block can be decoded alone through the index.

Segments are rows of a Parquet table in the folder all executors share, since
that is written through Spark's committers to any store: a lost executor's task
is repeated and only committed segments are ever read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaspan.llm.common import checkpoint_dir, ship, worker_cache

MAGIC = b"PFR1"
HEADER = struct.Struct("<4sIIQQI")
BLOCK = struct.Struct("<IBBHH")


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def _unpack(data: memoryview, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    if width <= 25:  # each value lies in the four bytes from its first bit's byte on
        first, shift = _places(n, width)
        words = np.ndarray((len(data) + 1,), "<u4", bytes(data) + b"\0\0\0\0", strides=(1,))
        return (words[first] >> shift) & np.uint32((1 << width) - 1)
    room = np.zeros((n, 32), np.uint8)
    room[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(room, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


@lru_cache(maxsize=64)
def _places(n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.arange(n, dtype=np.int64) * width
    return bits >> 3, (bits & 7).astype(np.uint32)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1]


def encode_block(values: np.ndarray, percentile: float) -> bytes:
    low = int(values.min())
    rest = values - np.uint32(low)
    need = _widths(rest)
    width = int(np.searchsorted(np.cumsum(np.bincount(need, minlength=33)), percentile * len(values)))
    over = np.flatnonzero(need > width)
    high = (rest[over].astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
    high_width = int(_widths(high).max()) if len(high) else 0
    body = rest & np.uint32((1 << width) - 1)
    return BLOCK.pack(low, width, high_width, len(values), len(over)) + _pack(body, width) + over.astype("<u2").tobytes() + _pack(high, high_width)


def decode_block(data: memoryview, at: int = 0) -> np.ndarray:
    low, width, high_width, n, n_over = BLOCK.unpack_from(data, at)
    at += BLOCK.size
    end = at + (n * width + 7) // 8
    values = _unpack(data[at:end], n, width)
    if n_over:
        places = np.frombuffer(data[end : end + 2 * n_over], "<u2")
        end += 2 * n_over
        high = _unpack(data[end : end + (n_over * high_width + 7) // 8], n_over, high_width)
        values[places] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return values + np.uint32(low)


def encode_segment(ids: np.ndarray, lengths: np.ndarray, block_size: int = 4096, percentile: float = 0.9) -> bytes:
    if not 0 < block_size <= 65535:
        raise ValueError("a block holds 1 to 65535 values")
    ids = np.ascontiguousarray(ids, np.uint32)
    blocks = [encode_block(ids[i : i + block_size], percentile) for i in range(0, len(ids), block_size)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8") if blocks else np.zeros(0, "<u8")
    return HEADER.pack(MAGIC, 1, block_size, len(lengths), len(ids), len(blocks)) + np.asarray(lengths, "<u4").tobytes() + starts.tobytes() + b"".join(blocks)


class Segment:
    """Reads a segment's image; `document(i)` decodes only the blocks it needs."""

    def __init__(self, image: bytes):
        view = memoryview(image)
        magic, version, self.block_size, docs, self.n_ids, n_blocks = HEADER.unpack_from(view)
        if (magic, version) != (MAGIC, 1):
            raise ValueError("not a segment")
        at = HEADER.size
        self.lengths = np.frombuffer(view[at : at + 4 * docs], "<u4")
        at += 4 * docs
        self.index = np.frombuffer(view[at : at + 8 * n_blocks], "<u8")
        self.blocks = view[at + 8 * n_blocks :]
        self.ends = np.cumsum(self.lengths, dtype=np.int64)

    def ids(self) -> np.ndarray:
        return np.concatenate([decode_block(self.blocks, int(x)) for x in self.index] or [np.zeros(0, np.uint32)])

    def document(self, i: int) -> np.ndarray:
        end = int(self.ends[i])
        start = end - int(self.lengths[i])
        if start == end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_size, (end - 1) // self.block_size
        found = np.concatenate([decode_block(self.blocks, int(self.index[b])) for b in range(first, last + 1)])
        return found[start - first * self.block_size : end - first * self.block_size]


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_NAMES = _byte_names()
#: All letters below are old enough for Python and the library to agree on what a letter is.
SETTLED = "\u0500"
#: Packing of so many ids.
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Ids(dict):
    """Little-endian u32 ids of a piece of text, from the library once for each distinct piece.

    A piece is a word that a space precedes (kept without the space), or a line
    feed and the word behind it. Where the first step is the byte-level pattern,
    letters with at most one mark behind them go to the library's model one by
    one, since the pattern cuts them nowhere but before the mark. Other new
    pieces go to the library as one text and come apart where an id begins with a
    space or a line feed, which are only found at the start of a piece. Should
    they come apart elsewhere, texts are encoded whole from then on. Texts that
    hold an added token are encoded whole as well. The cache starts anew at
    `limit` pieces or `limit_chars` characters, so its memory is bounded whatever
    the vocabulary.
    """

    def __init__(self, model: str, limit: int = 1_200_000, limit_chars: int = 18_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        model, step = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.tokenize = model.tokenize
        #: Tokens that the library looks for before anything else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.limit, self.limit_chars, self.chars = limit, limit_chars, 0
        self.starts = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.starts[i] = piece[:1] in ("Ġ", "Ċ")  # the byte-level names of space and line feed
        probe = [self.whole(x) for x in ("\na", "a", " a b\nc", " a", " b", "\nc")]
        line = self.whole("\n")
        #: False for tokenizers that don't cut before spaces and around line feeds; texts are then encoded whole.
        self.cuts = probe[0] == line + probe[1] and probe[2] == b"".join(probe[3:]) and len(line) == 4 and not any(c.isspace() for t in self.added for c in t)
        #: Whether letters may go to the model without the first step.
        self.letters = self.cuts and isinstance(model, models.BPE) and isinstance(step, pre_tokenizers.ByteLevel) and step.use_regex and self.tokenizer.normalizer is None
        self.line, self.marks = line, {x: self.whole(x) for x in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> bool:
        """Add distinct pieces that aren't known; false if the library doesn't cut them apart where it should."""
        joined = "".join([p if p[0] == "\n" else " " + p for p in new])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.starts[ids]).tolist()
        if len(at) != len(new) or at[0]:
            self.cuts = False
            return False
        data = ids.tobytes()
        self.update(zip(new, [data[4 * a : 4 * b] for a, b in zip(at, at[1:] + [len(ids)])]))
        self.chars += len(joined)
        return True

    def __missing__(self, piece: str) -> bytes | None:
        """Ids of a new piece of letters with at most one mark behind them; None for other pieces, which `learn` adds."""
        if not self.letters:
            return None
        feed = piece[0] == "\n"
        word, mark = piece[1:] if feed else piece, b""
        if not word.isalpha():
            mark, word = self.marks.get(word[-1:]), word[:-1]
            if mark is None or not word.isalpha():
                return None
            known = self.get("\n" + word if feed else word)
            if known is not None:
                found = self[piece] = known + mark
                self.chars += len(piece) + 1
                return found
        if not word.isascii():
            if max(word) >= SETTLED:
                return None
            word = word.encode().decode("latin-1").translate(BYTE_NAMES)
        ids = [t.id for t in self.tokenize(word if feed else "Ġ" + word)]
        if not feed and not self.starts[ids[0]]:
            return None
        data = PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()
        found = self[piece] = (self.line if feed else b"") + data + mark
        self.chars += len(piece) + 1
        return found

    def trim(self) -> None:
        if len(self) > self.limit or self.chars > self.limit_chars:
            self.clear()
            self.chars = 0


#: White space other than space and line feed, and characters on which libraries differ about white space.
_ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


_ODD_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"


def split_pieces(text: str) -> list[str] | None:
    """The text in pieces that the tokenizer's first step cuts apart, or None where white space meets white space."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text:
        return None
    if "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text):
        return None
    # Single characters are found faster than sets of them; texts of ASCII alone have few that are odd.
    if any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD.search(text):
        return None
    pieces = text.replace("\n", " \n").split(" ")
    pieces[0] = "\n" + pieces[0]  # the line feed's id is dropped again
    return pieces


def encode_texts(texts: list[str], ids: _Ids) -> list[bytes]:
    """The ids of each text, as the library gives them for the whole text."""
    out: list[bytes] = []
    for at in range(0, len(texts), 256):
        ids.trim()
        cut = [split_pieces(t) if ids.cuts and not any(x in t for x in ids.added) else None for t in texts[at : at + 256]]
        found = [list(map(ids.__getitem__, p)) if p else [] for p in cut]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = {p[i] for p, g in zip(cut, gaps) for i in g}
        if new and not ids.learn(list(new)):
            out.extend(map(ids.whole, texts[at : at + 256]))
            continue
        for text, pieces, known, gap in zip(texts[at : at + 256], cut, found, gaps):
            if pieces is None:
                out.append(ids.whole(text))
                continue
            for i in gap:
                known[i] = ids[pieces[i]]
            known[0] = known[0][4:]
            out.append(b"".join(known))
    return out


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer_json: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_size: int = 4096, percentile: float = 0.9, segment_ids: int = 1_000_000) -> None:
    """Write all ids of `docs` in ascending `id_col` order as segments beneath `path`.

    Null texts are empty (they yield the end id alone); null ids sort first;
    rows with equal ids stand in order of a hash of their text, so a range may
    end between them, and rows that agree in both are interchangeable; repeated
    rows are written as often as they occur. An empty table writes no segment.
    Only the two named columns are read, so others may have any name. Texts are
    read whole, whatever their length, and added tokens in them count as the
    library counts them. They are range-partitioned by id and encoded after the
    shuffle, so ids are never shuffled; the range sampling reads rows but encodes
    none.
    """
    ship(spark)
    model = spark.sparkContext.broadcast(tokenizer_json)
    key = ("token ids", zlib.crc32(tokenizer_json.encode()))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = worker_cache(key, lambda: _Ids(model.value))
        end = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        keys: list[int | None] = []
        part, size, number = TaskContext.get().partitionId(), 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, keys, size, number
            lengths = np.array([len(x) // 4 for x in held], "<u4")
            image = encode_segment(np.frombuffer(b"".join(held), "<u4"), lengths, block_size, percentile)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([image], pa.binary())],
                ["part", "number", "ids", "n_ids", "image"],
            )
            held, keys, size, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                found = encode_texts([t or "" for t in piece.column(1).to_pylist()], ids)
                for doc_id, data in zip(piece.column(0).to_pylist(), found):
                    held.append(data + end)
                    keys.append(doc_id)
                    size += len(data) // 4 + 1
                    if size >= segment_ids:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("key"), F.col("hash")).sortWithinPartitions("key", "hash", "text").select("key", "text")
    ordered.mapInArrow(segments, "part int, number int, ids array<bigint>, n_ids bigint, image binary").write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the written segments: doc_id, start, n_tokens, ids_crc32, segment, place.

    Segments get their offsets in two steps: a window over one row per writing
    task, and windows over the segments (a million ids each) of each task.
    """
    ship(spark)
    written = spark.read.parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, keys, image in zip(*(batch.column(i).to_pylist() for i in range(4))):
                segment = Segment(image)
                data = segment.ids().astype("<u4", copy=False)
                ends = segment.ends
                starts = ends - segment.lengths
                crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(segment.lengths.astype(np.int64), pa.int64()), pa.array(crc, pa.int64())], ["part", "number", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = written.select("part", "number", "ids", "image").mapInArrow(documents, "part int, number int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = written.select("part", "number", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all_"))
    parts = parts.select("part", (F.sum("all_").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("all_")).alias("first_"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_ids")
    offsets = sizes.withColumn("inside_", inside).join(parts, "part").select("part", "number", (F.col("first_") + F.col("inside_")).alias("base"))
    return read.join(offsets, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", F.col("part").alias("segment_part"),
        F.col("number").alias("segment_number"),
    )


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    path = f"{checkpoint_dir(spark)}/token_ids_{uuid.uuid4().hex}"
    write_ids(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), model, path)
    return read_ids(spark, path)
