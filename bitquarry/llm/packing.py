"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's ids are those of the byte-level BPE, plus an end id.  Whole
``max_tokens`` stretches of a long document become sequences of their own.  What
is left of each document is packed block by block: a block's pieces are taken
in descending cost (``linear * n + quadratic * n**2``: the dense layers and the
attention inside the piece) and each goes to the open sequence of lowest cost
among those with room for it.  A piece that fits nowhere is cut over the
sequences with the most room, so a block fills its sequences completely; less
than a sequence is carried to the next block, and only the last sequence of a
partition is padded.

The plan is one scan and one Arrow map without a shuffle.  A task holds one
block (``block_sequences * max_tokens`` ids) and a bounded word cache.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A space or line feed before other white space or at the end: no fast path.
_ODD = re.compile(r"[ \n](?=\s|\Z)")
#: The vocabulary's one special token; its string in a text is that token, as the JSON form of the tokeniser has it.
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Texts -> ids as little-endian uint32 bytes.

    The pre-tokeniser never joins a single space or line feed between visible
    characters with what stands before it.  Such texts are split there, and the
    units (each with its leading space or line feed) come from a cache of at
    most ``most`` units; those of a batch that it lacks are encoded by one call.
    All other texts go through the tokeniser whole.
    """

    def __init__(self, ranks_path: str, most: int = 250_000):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: max(ranks.values()) + 1})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.sizes[k] = len(token)
        self.most, self.units = most, {}

    def _learn(self, units: list[str]) -> None:
        units = [u if u[:1] == "\n" else " " + u for u in units]
        ids = self.bpe.encode_to_numpy("".join(units), allowed_special="all")
        lengths = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths)) + 1
        ids, begin = ids.astype("<u4").tobytes(), 0
        for u, end in zip(units, (4 * ends).tolist()):
            self.units[u if u[0] == "\n" else u[1:]] = ids[begin:end]
            begin = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if not t or t[0].isspace() or _ODD.search(t) or _SPECIAL in t else ("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        if len(self.units) > self.most:
            self.units = {}
        if new := set().union(*filter(None, split)).difference(self.units):
            self._learn(list(new))
        get = self.units.__getitem__
        return [self.bpe.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() if u is None else b"".join(map(get, u))[4:] for t, u in zip(texts, split)]


def assign(lengths: list[int], sequences: int, max_tokens: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start in it, length, sequence) for a block; may leave less than a sequence unplaced.

    lengths must be in descending order.
    """
    room = np.full(sequences, max_tokens, np.int64)
    cost = np.zeros(sequences)

    def put(piece: int, start: int, n: int, where: int) -> tuple[int, int, int, int]:
        room[where] -= n
        cost[where] += linear * n + quadratic * n * n
        return piece, start, n, where

    for piece, n in enumerate(lengths):
        start = 0
        while n:
            fits = np.where(room >= n, cost, np.inf)
            where = int(fits.argmin())
            if fits[where] < np.inf:
                yield put(piece, start, n, where)
                break
            where = int(room.argmax())
            if not (part := int(room[where])):
                break
            yield put(piece, start, part, where)
            start, n = start + part, n - part


def pack_partition(docs: Iterable[tuple[int, bytes]], max_tokens: int, block_sequences: int, linear: float, quadratic: float) -> Iterator[tuple]:
    """(doc_id, start, ids, doc_tokens, sequence, offset) of each piece; sequences count from 0."""
    made, held, held_tokens = 0, [], 0

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal made, held, held_tokens
        held.sort(key=lambda p: -len(p[2]))
        sequences = -(-held_tokens // max_tokens) if last else held_tokens // max_tokens
        used, at = [0] * len(held), [0] * sequences
        for k, start, n, where in assign([len(p[2]) // 4 for p in held], sequences, max_tokens, linear, quadratic):
            doc, begun, ids, total = held[k]
            yield doc, begun + start, ids[4 * start : 4 * (start + n)], total, made + where, at[where]
            at[where] += n
            used[k] = start + n
        made += sequences
        held = [(d, s + u, ids[4 * u :], t) for (d, s, ids, t), u in zip(held, used) if 4 * u < len(ids)]
        held_tokens = sum(len(p[2]) for p in held) // 4

    for doc, ids in docs:
        total = len(ids) // 4
        whole = total - total % max_tokens
        for start in range(0, whole, max_tokens):
            yield doc, start, ids[4 * start : 4 * (start + max_tokens)], total, made, 0
            made += 1
        if whole < total:
            held.append((doc, whole, ids[4 * whole :], total))
            held_tokens += total - whole
            if held_tokens >= block_sequences * max_tokens:
                yield from flush(False)
    yield from flush(True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, block_sequences: int = 512, linear: float = 1.0, quadratic: float = 1 / 1024, end_id: int = 0, ranks_path: str = RANKS) -> DataFrame:
    """Pack all documents; one row for each piece.

    Columns: doc_id, start, length, ids (binary, little-endian uint32),
    doc_tokens, sequence_id, offset.  Null and empty texts are the end id alone.
    A null id is kept as null; repeated rows are packed each for itself; ties in
    cost go to the lowest sequence.  An empty table gives no rows.  Other
    columns are ignored.  sequence_id is the partition's number and a count in
    it, so a retried task gives the same ids.
    """
    tail = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks_path)
        base = TaskContext.get().partitionId() << 32

        def encoded():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                        yield doc, ids + tail

        rows: list[tuple] = []
        for doc, start, ids, total, sequence, offset in pack_partition(encoded(), max_tokens, block_sequences, linear, quadratic):
            rows.append((doc, start, len(ids) // 4, ids, total, base + sequence, offset))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids; Spark's crc32 is unsigned."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
