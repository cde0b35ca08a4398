"""Row filters of many images, their undoing, and the hash by brute force."""

import numpy as np
import pytest

from bitquarry.llm import media


def plain_undo(rows):
    """The PNG standard's definition, pixel by pixel."""
    out = np.zeros((len(rows), rows.shape[1] - 1), int)
    for y in range(len(rows)):
        for x in range(out.shape[1]):
            a, b, c = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0), (out[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (rows[y, x + 1] + (0, a, b, (a + b) // 2, near)[rows[y, 0]]) & 255
    return out.astype(np.uint8)


@pytest.mark.parametrize("together", [1, 8, 1000])
def test_undoing_many_images(together):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (rng.integers(0, 9), 30), dtype=np.uint8) for _ in range(30)]
    for i in images:
        i[:, 0] = rng.integers(0, 5, len(i))
    for ours, rows in zip(media.unfilter(images, together), images):
        assert np.array_equal(ours, plain_undo(rows))


def test_best_filters_round_trip():
    rng = np.random.default_rng(2)
    samples = [rng.integers(0, 256, 64 * n, dtype=np.uint8).cumsum().astype(np.uint8).tobytes() for n in (1, 3, 2000, 0, 7)] + [b"plain text of the row " * 64, b"\0" * 640]
    media_ = media.encode_many(samples, 64)
    assert media_ == [media.encode_png(x, 64) for x in samples]
    kinds = np.concatenate([media.inflated(x)[:, 0] for x in media_])
    assert len(np.unique(kinds)) > 2
    for x, image in zip(samples, media.decode_many(media_)):
        assert image.tobytes() == x
    filters = media.filtered(np.frombuffer(samples[1], np.uint8).reshape(-1, 64), np.array([True, False, False]))
    assert np.array_equal(plain_undo(filters).tobytes(), samples[1])


def test_table_texts_use_filters():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    data = [(t or "").encode() for t in texts]
    png = media.encode_many([x + b"\xff" * (-len(x) % 576 if x else 576) for x in data], 576)
    kinds = np.bincount(np.concatenate([media.inflated(x)[:, 0] for x in png]), minlength=5)
    assert (kinds[1:] > 0).sum() >= 2
    assert all(i.tobytes()[: len(x)] == x for i, x in zip(media.decode_many(png), data))


def test_hash_by_brute_force():
    rng = np.random.default_rng(3)
    for shape in ((1, 576), (5, 576), (64, 64), (40, 96), (33, 50)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        h, w = shape
        small = np.zeros((32, 32))
        for i in range(32):
            for j in range(32):
                # Means over stretches of the height and the width, parts of pixels by their share.
                rows = np.clip(np.minimum(np.arange(h) + 1, (i + 1) * h / 32) - np.maximum(np.arange(h), i * h / 32), 0, None)
                cols = np.clip(np.minimum(np.arange(w) + 1, (j + 1) * w / 32) - np.maximum(np.arange(w), j * w / 32), 0, None)
                small[i, j] = rows @ image @ cols / (rows.sum() * cols.sum())
        low = np.array([[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).round(5).ravel()
        want = low > np.median(low[1:])
        got = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(image)), np.uint8)).astype(bool)
        apart = np.abs(low - np.median(low[1:]))
        unsure = (apart > 0) & (apart < 1e-2)
        assert np.array_equal(got[~unsure], want[~unsure]) and unsure.sum() <= 8
