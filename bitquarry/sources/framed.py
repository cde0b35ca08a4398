"""Files of packed messages, each after its length as four bytes, the highest first.

``read_framed`` goes through Spark's binary file source, so any store that Spark
reaches will do.  ``PackedFiles`` is a Python data source (format ``packed``) for
mounted folders: it reads and decodes in one scan, part by part of large files,
and writes with a commit.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from bitquarry.functions.bits import CodecError
from bitquarry.schema.compiler import compile_text
from bitquarry.schema.nodes import decode_one, encode_one


#: Added to a file's name for its index: positions of frames at which parts begin, eight bytes each.
INDEX = ".idx"


def frame(message: bytes) -> bytes:
    return struct.pack(">I", len(message)) + message


def frames(data: bytes) -> Iterator[bytes]:
    """The messages; ValueError where the data ends inside one."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("a length is cut short")
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            raise ValueError("a message is cut short")
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def split_frames(df: DataFrame, content: str = "content", out: str = "payload", most: int = 8192) -> DataFrame:
    """A row for each message of a binary column of frames, in batches of up to ``most`` messages; null content gives none."""
    others = [c for c in df.columns if c != content]
    kept = T.StructType([f for f in df.schema.fields if f.name != content])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, data = batch.slice(k, 1), batch.column(len(others))[k].as_py()
                messages = frames(data or b"")
                while some := list(islice(messages, most)):
                    same = own.take(pa.array([0] * len(some)))
                    yield pa.RecordBatch.from_arrays([*same.columns[:-1], pa.array(some, pa.binary())], names=[*others, out])

    return df.select(*(F.col(f"`{c}`") for c in others), content).mapInArrow(run, T.StructType([*kept.fields, T.StructField(out, T.BinaryType())]))


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload) of all messages under a path."""
    return split_frames(spark.read.format("binaryFile").load(path).select("path", "content"))


@dataclass
class _Part(InputPartition):
    """A stretch of a file, from one frame's begin to another's."""

    path: str
    start: int
    stop: int


@dataclass
class _Written(WriterCommitMessage):
    moved: list[tuple[str, str]]


def stretches(path: str) -> list[_Part]:
    """The parts of a file: as its index says, or the whole file where it has none."""
    size = os.path.getsize(path)
    marks = [0]
    if os.path.exists(path + INDEX):
        with open(path + INDEX, "rb") as f:
            marks = [x for (x,) in struct.iter_unpack(">Q", f.read())] or marks
    return [_Part(path, a, b) for a, b in zip(marks, [*marks[1:], size]) if a < b]


def streamed(part: _Part, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The messages of a part, with a chunk and one message in memory."""
    with open(part.path, "rb") as f:
        f.seek(part.start)
        held, left = b"", part.stop - part.start
        while held or left:
            need = 4 + struct.unpack_from(">I", held)[0] if len(held) >= 4 else 4
            if len(held) < need:
                more = f.read(min(left, max(chunk, need - len(held))))
                if not more:
                    raise ValueError("a message is cut short" if len(held) >= 4 else "a length is cut short")
                left -= len(more)
                held += more
                continue
            at = 0
            while at + 4 <= len(held) and at + 4 + struct.unpack_from(">I", held, at)[0] <= len(held):
                n = struct.unpack_from(">I", held, at)[0]
                yield held[at + 4 : at + 4 + n]
                at += 4 + n
            held = held[at:]


class PackedFiles(DataSource):
    """Format ``packed``; options: path, and schema_text (a YAML document) with type (a type's name)."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def _node(self):
        return compile_text(self.options["schema_text"])[self.options["type"]]

    def schema(self):
        return self._node().spark_type()

    def reader(self, schema):
        return _Reader(self._node(), self.options["path"], self.options.get("mode", "PERMISSIVE"))

    def writer(self, schema, overwrite):
        return _Writer(self._node(), self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, node, path: str, mode: str):
        self.node, self.path, self.mode = node, path, mode

    def partitions(self):
        names = sorted(glob.glob(os.path.join(self.path, "[!_]*.bin"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [p for n in names for p in stretches(n)]

    def read(self, partition):
        if partition is None:
            return
        names = [k for k, _ in self.node.fields]
        for message in streamed(partition):
            try:
                value, *_ = decode_one(self.node, message)
            except CodecError:
                if self.mode == "FAILFAST":
                    raise
                if self.mode == "PERMISSIVE":
                    yield tuple(None for _ in names)
                continue
            yield tuple(value[k] for k in names)


class _Writer(DataSourceWriter):
    """A file a task under a hidden name, with an index of where parts begin; the commit of the whole write shows them.

    An overwrite shows the new files before it removes the old ones, so a failure
    in between leaves both and loses nothing.
    """

    def __init__(self, node, path: str, overwrite: bool, part_bytes: int = 32 << 20):
        self.node, self.path, self.overwrite, self.part_bytes = node, path, overwrite, part_bytes

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        name = f"{uuid.uuid4().hex}.bin"
        hidden, shown = os.path.join(self.path, f"_{name}"), os.path.join(self.path, name)
        marks, at = [0], 0
        with open(hidden, "wb") as f:
            for row in iterator:
                data = frame(encode_one(self.node, row.asDict(True))[0])
                if at - marks[-1] >= self.part_bytes:
                    marks.append(at)
                f.write(data)
                at += len(data)
        with open(hidden + INDEX, "wb") as f:
            f.write(b"".join(struct.pack(">Q", x) for x in marks))
        return _Written([(hidden + INDEX, shown + INDEX), (hidden, shown)])

    def commit(self, messages):
        old = glob.glob(os.path.join(self.path, "[!_]*.bin")) if self.overwrite else []
        for m in messages:
            for pair in m.moved if m is not None else []:
                os.replace(*pair)
        for name in old:
            os.remove(name)
            if os.path.exists(name + INDEX):
                os.remove(name + INDEX)

    def abort(self, messages):
        for m in messages:
            for hidden, _ in m.moved if m is not None else []:
                if os.path.exists(hidden):
                    os.remove(hidden)
