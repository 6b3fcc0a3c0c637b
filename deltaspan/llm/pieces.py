"""Encoding and decoding with merge-type SentencePiece vocabularies.

An agenda holds the adjacent pairs of symbols whose concatenation is a piece.
The pair of the best score, the leftmost among equals, merges next and puts its
new neighbours on the agenda. What no merge reached and is no piece falls back
to bytes.

Two facts make it fast without changing a result. A merge never crosses two
neighbouring characters that stand side by side in no piece, so a text may be
cut there, and each distinct part meets the agenda once per worker. In
vocabularies where the space mark only starts a piece, texts may be cut before
each run of marks.

Arrow batches are checked against the sentencepiece library: it encodes every
chunk that is new in a batch, and whole texts for one in WHOLE hashes of a text.
What is returned is the agenda's in any case; where ids or decoded text differ
from the library's, `agrees` is false.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaspan.llm.common import ship, worker_cache

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: One in so many texts (by crc32) is checked as a whole.
WHOLE = 16
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Vocabulary:
    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    dummy_prefix: bool
    byte_fallback: bool
    ids: dict[str, int] = field(default_factory=dict)
    pairs: set[str] = field(default_factory=set)
    marks_lead: bool = True

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2:
            raise ValueError("the vocabulary isn't of the merge type")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies without text normalization are supported")
        kinds = [p.type for p in proto.pieces]
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("vocabularies with user-defined or unused pieces aren't supported")
        own = cls([p.piece for p in proto.pieces], kinds, [p.score for p in proto.pieces], norm.add_dummy_prefix, train.byte_fallback)
        for i, (piece, kind) in enumerate(zip(own.pieces, kinds)):
            if kind == NORMAL:
                own.ids[piece] = i
                own.pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
                own.marks_lead &= MARK not in piece.lstrip(MARK)
        own.rank = {piece: -own.scores[i] for piece, i in own.ids.items() if len(piece) > 1}
        own.decimal = [str(i) for i in range(len(own.pieces))]
        own.plain = [p.replace(MARK, " ") if k == NORMAL else None for p, k in zip(own.pieces, kinds)]
        own.unknown = kinds.index(UNKNOWN)
        own.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(own.pieces, kinds)) if k == BYTE}
        own.byte_of = {i: b for b, i in own.bytes.items()}
        return own

    def agenda(self, symbols: str) -> list[int]:
        """Ids of one part of a text."""
        ids, rank = self.ids, self.rank.get
        if len(symbols) == 1 and symbols in ids:
            return [ids[symbols]]
        text: list[str | None] = list(symbols)
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            merged = symbols[i : i + 2]
            cost = rank(merged)
            if cost is not None:
                heap.append((cost, i, i + 1, merged))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, left, right, merged = pop(heap)
            a, b = text[left], text[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != len(merged):
                continue  # one of the two has merged meanwhile
            text[left], text[right] = merged, None
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                new = merged + text[beyond]
                cost = rank(new)
                if cost is not None:
                    push(heap, (cost, left, beyond, new))
            first = before[left]
            if first >= 0:
                new = text[first] + merged
                cost = rank(new)
                if cost is not None:
                    push(heap, (cost, first, left, new))
        out: list[int] = []
        for piece in text:
            if piece is None:
                continue
            k = ids.get(piece)
            if k is not None:
                out.append(k)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out

    def parts(self, chunk: str) -> list[str]:
        """The chunk, cut between neighbours that no piece joins."""
        pairs = self.pairs
        cuts = [i for i, pair in enumerate(map(str.__add__, chunk, chunk[1:]), 1) if pair not in pairs]
        if not cuts:
            return [chunk]
        return [chunk[i:j] for i, j in zip([0, *cuts], [*cuts, None])]

    def chunks(self, text: str) -> list[str]:
        """The text with marks for spaces, cut before runs of marks."""
        if not text:
            return []
        if self.marks_lead and self.dummy_prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return [MARK + x for x in text.split(" ")]
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return _RUNS.findall(marked) if self.marks_lead else [marked]

    def raw(self, ids: list[int]) -> str:
        """The text of ids, the dummy prefix kept."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # some id isn't a normal piece
            pass
        out: list[str] = []
        run = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i].replace(MARK, " ") if kind == NORMAL else " ⁇ " if kind == UNKNOWN else "")
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.raw(ids)
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class Encoder:
    """Remembers the chunks and parts of a vocabulary with a dummy prefix, up to a bound each; then it starts anew.

    Chunks are kept without the mark that leads them, their ids as decimals.
    Decoded text is kept only where it isn't the chunk with spaces for marks.
    """

    def __init__(self, model: bytes, check: bool = True, limit: int = 550_000, limit_chars: int = 8_000_000, whole: int = WHOLE):
        self.vocabulary = Vocabulary.load(model)
        self.whole = whole
        self.limit, self.limit_chars, self.limit_parts, self.chars = limit, limit_chars, limit * 3 // 4, 0
        self.ids: dict[str, bytes] = {}
        self.by_part: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.disagree: set[str] = set()
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)

    def part(self, part: str) -> bytes:
        """Ids of a part as decimals."""
        found = self.by_part.get(part)
        if found is None:
            found = ",".join(map(self.vocabulary.decimal.__getitem__, self.vocabulary.agenda(part))).encode()
            if len(part) <= 64:
                if len(self.by_part) >= self.limit_parts:
                    self.by_part.clear()
                self.by_part[part] = found
        return found

    def keys(self, text: str) -> list[str]:
        """The chunks of a text without their leading marks."""
        if not text:
            return []
        if self.vocabulary.marks_lead and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in self.vocabulary.chunks(text)]

    def learn(self, new: list[str]) -> None:
        """Add distinct chunks that aren't known."""
        self.chars += sum(map(len, new))
        decimal, parts, part = self.vocabulary.decimal.__getitem__, self.vocabulary.parts, self.part
        # Words of letters alone are rarely cut, so they aren't searched for cuts.
        found = [part(MARK + k) if k.isalpha() and len(k) < 64 else b",".join([part(p) for p in parts(MARK + k)]) for k in new]
        given = self.library.encode([k.replace(MARK, " ") for k in new], num_threads=1) if self.library is not None else [None] * len(new)
        for key, own, ids in zip(new, found, given):
            # The library gives a lone mark no prefix, so that isn't compared.
            if not ids or not key or ",".join(map(decimal, ids)).encode() != own:
                if ids and key:
                    self.disagree.add(key)
                ids = list(map(int, own.split(b",")))
            self.ids[key] = own
            text = self.vocabulary.raw(ids)
            if text != " " + key.replace(MARK, " "):
                self.decoded[key] = text

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, str, bool]]:
        """Ids as decimals, the decoded text, and whether the library agrees, of each text.

        The library encodes every chunk that is new in the batch, and one in
        `whole` texts.
        """
        if not self.vocabulary.dummy_prefix:
            for text in texts:
                ids = b",".join([self.part(p) for c in self.vocabulary.chunks(text) for p in self.vocabulary.parts(c)])
                decoded = self.vocabulary.decode(list(map(int, ids.split(b","))) if ids else [])
                yield ids, decoded, self.agrees(text, ids, decoded)
            return
        if len(self.ids) > self.limit or self.chars > self.limit_chars:
            for held in (self.ids, self.decoded, self.disagree):
                held.clear()
            self.chars = 0
        cut = [self.keys(t) for t in texts]
        found = [list(map(self.ids.get, keys)) for keys in cut]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = {keys[i] for keys, gap in zip(cut, gaps) for i in gap}
        if new:
            self.learn(list(new))
        for text, keys, known, gap in zip(texts, cut, found, gaps):
            for i in gap:
                known[i] = self.ids[keys[i]]
            ids = b",".join(known)
            if self.decoded and not self.decoded.keys().isdisjoint(keys):
                decoded = "".join([self.decoded.get(k, " " + k.replace(MARK, " ")) for k in keys])[1:]
            else:
                decoded = " ".join(keys).replace(MARK, " ")
            yield ids, decoded, self.agrees(text, ids, decoded) and not (self.disagree and not self.disagree.isdisjoint(keys))

    def agrees(self, text: str, ids: bytes, decoded: str) -> bool:
        """False if the library, asked for one in `whole` texts, gives other ids or another text."""
        if self.library is None or (self.whole > 1 and zlib.crc32(text.encode()) % self.whole):
            return True
        found = self.library.encode(text)
        return ",".join(map(str, found)).encode() == ids and self.library.decode(found) == decoded


def encode_documents(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", check: bool = True, with_ids: bool = False, cache: int = 550_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees; with_ids adds ids and the decoded text.

    Null texts are empty: no ids, the hashes of the empty string. Rows keep
    their number: ids may be null and rows repeat, each with a row of its own;
    an empty table gives none. Only the two named columns are read, so others
    may have any name. Texts are encoded whole, whatever their length. Nothing
    is shuffled. A worker remembers up to `cache` chunks.
    """
    spark = docs.sparkSession
    ship(spark)
    held, key = spark.sparkContext.broadcast(model), ("pieces", check, cache, hashlib.sha256(model).digest())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(key, lambda: Encoder(held.value, check, cache))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids_sha, text_sha, agrees, ids, texts = [], [], [], [], [], []
                for decimals, decoded, same in encoder.batch([t or "" for t in part.column(1).to_pylist()]):
                    n.append(decimals.count(b",") + 1 if decimals else 0)
                    ids_sha.append(hashlib.sha256(decimals).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    agrees.append(same)
                    if with_ids:
                        ids.append(np.array(decimals.split(b",") if decimals else [], np.int32))
                        texts.append(decoded)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(agrees, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, schema)


def public_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_model())
