"""Binary media columns: PNG coding on zlib and numpy, and cosine-transform hashes.

The writer makes 8-bit greyscale PNG and picks each row's filter by the least sum
of absolute values; the reader walks the chunks, tests each checksum, inflates
the image data and undoes the row filters with numpy, over the rows of many
images at a time.  The hash is of the lowest frequencies of a two-dimensional
cosine transform of the image reduced to 32 x 32, so it hardly changes under
small edits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitquarry.llm.tables import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi * np.outer(np.arange(_LOW), 2 * np.arange(_SIDE) + 1) / (2 * _SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(rows: np.ndarray, first: np.ndarray, kinds: np.ndarray | None = None, block: int = 1024) -> np.ndarray:
    """Each row after its filter's number: 0 none, 1 left, 2 above, 3 mean, 4 Paeth.

    first says which rows begin an image.  Without kinds each row has the filter
    whose bytes, as signed numbers, have the least sum of absolute values (the
    smaller number on a tie).
    """
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    for at in range(0, len(rows), block):
        x = rows[at : at + block].astype(np.int16)
        up = np.vstack([rows[at - 1 : at] if at else rows[:1], rows[at : at + block - 1] if at + block <= len(rows) else rows[at:-1]]).astype(np.int16)[: len(x)]
        up[first[at : at + block]] = 0
        left, corner = (np.hstack([np.zeros_like(y[:, :1]), y[:, :-1]]) for y in (x, up))
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        each = [((x - guess) & 255).astype(np.uint8) for guess in (np.zeros_like(x), left, up, (left + up) >> 1, paeth)]
        if kinds is None:
            own = np.argmin([np.abs(y.view(np.int8).astype(np.int16)).sum(1) for y in each], axis=0)
        else:
            own = kinds[at : at + block]
        out[at : at + block, 0] = own
        for k, y in enumerate(each):
            out[at : at + block, 1:][own == k] = y[own == k]
    return out


def _row_undone(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """One row without its mean or Paeth filter."""
    out, left, corner = [], 0, 0
    if kind == 3:
        for x, up in zip(row.tolist(), above.tolist()):
            left = x + (left + up >> 1) & 255
            out.append(left)
    else:
        for x, up in zip(row.tolist(), above.tolist()):
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            left = x + (left if a <= b and a <= c else up if b <= c else corner) & 255
            corner = up
            out.append(left)
    return np.array(out, np.uint8)


def _rows_undone(kind: int, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of different images without their mean or Paeth filter, a column at a time."""
    x, up = rows.T.astype(np.int16), above.T.astype(np.int16)
    out = np.empty_like(x)
    left = corner = np.zeros(x.shape[1], np.int16)
    for j in range(len(x)):
        if kind == 3:
            guess = (left + up[j]) >> 1
        else:
            a, b, c = np.abs(up[j] - corner), np.abs(left - corner), np.abs(left + up[j] - 2 * corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[j], corner))
            corner = up[j]
        out[j] = left = (x[j] + guess) & 255
    return out.T.astype(np.uint8)


def unfilter(images: list[np.ndarray], together: int = 8) -> list[np.ndarray]:
    """Images of rows of one width, each row after its filter's number.  The k-th rows of all images are undone together."""
    if any(i.size and i[:, 0].max() > 4 for i in images):
        raise ValueError("unknown row filter")
    out = [i[:, 1:].copy() for i in images]
    order = sorted(range(len(images)), key=lambda n: -len(images[n]))
    for k in range(max(map(len, images), default=0)):
        while order and len(images[order[-1]]) <= k:
            order.pop()
        kinds = np.array([images[n][k, 0] for n in order])
        for kind in np.unique(kinds).tolist():
            own = [n for n, x in zip(order, kinds.tolist()) if x == kind]
            above = [out[n][k - 1] if k else np.zeros_like(out[n][k]) for n in own]
            if kind == 1:
                for n in own:
                    out[n][k] = np.cumsum(out[n][k], dtype=np.uint8)
            elif kind == 2:
                for n, up in zip(own, above):
                    out[n][k] += up
            elif kind and len(own) < together:
                for n, up in zip(own, above):
                    out[n][k] = _row_undone(kind, out[n][k], up)
            elif kind:
                for n, row in zip(own, _rows_undone(kind, np.stack([out[n][k] for n in own]), np.stack(above))):
                    out[n][k] = row
    return out


def encode_many(samples: list[bytes], width: int, level: int = 1, kind: int | None = None, chunk_bytes: int = 1 << 16) -> list[bytes]:
    """Greyscale PNGs of samples, row by row, with a filter for all rows or (None) the best for each."""
    images = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in samples]
    if not images:
        return []
    sizes = np.array([len(i) for i in images])
    ends = np.cumsum(sizes)
    first = np.zeros(ends[-1], bool)
    first[(ends - sizes)[sizes > 0]] = True
    rows = filtered(np.concatenate(images), first, None if kind is None else np.full(ends[-1], kind))
    out = []
    for end, n in zip(ends.tolist(), sizes.tolist()):
        packed = zlib.compress(rows[end - n : end].tobytes(), level)
        head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, n, 8, 0, 0, 0, 0))
        out.append(SIGNATURE + head + b"".join(_chunk(b"IDAT", packed[k : k + chunk_bytes]) for k in range(0, len(packed), chunk_bytes)) + _chunk(b"IEND", b""))
    return out


def encode_png(samples: bytes, width: int, level: int = 1, kind: int | None = None, chunk_bytes: int = 1 << 16) -> bytes:
    """A greyscale PNG of the samples."""
    return encode_many([samples], width, level, kind, chunk_bytes)[0]


def inflated(data: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit greyscale PNG; ValueError names the check that failed."""
    if data[:8] != SIGNATURE:
        raise ValueError("no signature")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None:
        raise ValueError("cut short")
    if head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale without interlace")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("size of the image data")
    rows = np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1)
    if rows.size and rows[:, 0].max() > 4:
        raise ValueError("unknown row filter")
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """The image of an 8-bit greyscale PNG; ValueError names the check that failed."""
    return unfilter([inflated(data)])[0]


def decode_many(datas: list[bytes | None]) -> list[np.ndarray | str]:
    """The image of each PNG, or which check failed; those of one width are undone together."""
    out: list[np.ndarray | str] = []
    by_width: dict[int, list[int]] = {}
    for data in datas:
        try:
            out.append(inflated(data or b""))
            by_width.setdefault(out[-1].shape[1], []).append(len(out) - 1)
        except ValueError as e:
            out.append(str(e))
    for own in by_width.values():
        for n, image in zip(own, unfilter([out[n] for n in own])):
            out[n] = image
    return out


def _reduced(x: np.ndarray, n: int) -> np.ndarray:
    """Rows averaged over n equal stretches of the height."""
    sums = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    at = np.arange(n + 1) * (len(x) / n)
    whole = np.minimum(at.astype(np.int64), len(x) - 1)
    marks = sums[whole] + (at - whole)[:, None] * x[whole]
    return np.diff(marks, axis=0) / (len(x) / n)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest frequencies lie above the median, without the mean."""
    if image.shape[1] % _SIDE:
        small = _reduced(_reduced(image, _SIDE).T, _SIDE).T
    else:
        each = image.shape[1] // _SIDE
        columns = image.astype(np.float32) @ np.repeat(np.eye(_SIDE, dtype=np.float32), each, axis=0)
        small = _reduced(columns.astype(np.float64) / each, _SIDE)
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _map(df: DataFrame, ddl: str, types: list[pa.DataType], rows) -> DataFrame:
    """df through a function from columns (lists) to rows, on slices of bounded rows and bytes of the last column."""
    schema = pa.schema(list(zip((x.split()[0] for x in ddl.split(", ")), types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                done = rows(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], schema=schema)

    return df.mapInArrow(run, ddl)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 576, level: int = 1, kind: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 as a PNG of rows of width samples, padded by 255.

    Null texts are empty; an empty text is one row of padding.  Texts are kept
    whole; null and repeated ids and repeated rows are each encoded, equal texts
    to equal bytes.  An empty table gives no rows; other columns play no part.
    """

    def rows(docs, texts):
        data = [(t or "").encode() for t in texts]
        media = encode_many([x + b"\xff" * (-len(x) % width if x else width) for x in data], width, level, kind)
        return list(zip(docs, map(len, data), media))

    return _map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, n_bytes long, media binary", [pa.int64(), pa.int64(), pa.binary()], rows)


def features(media: DataFrame) -> DataFrame:
    """Facts of each stored image (doc_id, n_bytes, media), from the bytes as read back.

    An image that fails a check has null payload columns and the reason in
    ``error``; null media likewise.
    """
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def rows(docs, sizes, datas):
        out = []
        for doc, n, data, image in zip(docs, sizes, datas, decode_many(datas)):
            sha = hashlib.sha256(data or b"").hexdigest()
            if isinstance(image, str):
                out.append((doc, n, None, None, None, len(data or b""), sha, None, image))
                continue
            payload = image.tobytes()
            out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), sha, cosine_hash(image), None))
        return out

    i, s = pa.int64(), pa.string()
    return _map(media.select("doc_id", "n_bytes", "media"), ddl, [i, i, i, s, i, i, s, s, s], rows)
