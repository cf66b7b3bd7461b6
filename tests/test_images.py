import os
import struct
import zlib

import numpy as np
import pytest

from vistaforge.sources import catalog, images

RNG = np.random.default_rng(0)
PICTURE = RNG.integers(0, 256, (21, 34, 3)).astype(np.uint8)


def png(lines, w, h, depth, colour, *extra):
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + b"".join(part(*e) for e in extra) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def filtered(x, kind):
    out, before = b"", np.zeros(x.shape[1] * 3, int)
    for line in x.reshape(len(x), -1).astype(int):
        left, corner = np.append([0] * 3, line[:-3]), np.append([0] * 3, before[:-3])
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0 * line, left, before, (left + before) // 2, near][kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    return out


@pytest.mark.parametrize("kind", range(5))
def test_png_of_every_filter(kind):
    assert (images.decode(png(filtered(PICTURE, kind), 34, 21, 8, 2)) == PICTURE).all()


def test_other_formats():
    assert (images.decode(images.encode_png(PICTURE)) == PICTURE).all()
    assert images.decode(png(b"\x00\xb0", 4, 1, 1, 0))[0, :, 1].tolist() == [255, 0, 255, 255]
    assert images.decode(png(b"\x00\x1b", 4, 1, 2, 3, (b"PLTE", bytes(range(12)))))[0].tolist() == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    assert images.decode(png(b"\x00" + bytes([1, 2, 3, 4]), 1, 1, 8, 6))[0, 0].tolist() == [1, 2, 3]
    assert (images.decode(b"P6\n# made here\n34 21\n255\n" + PICTURE.tobytes()) == PICTURE).all()
    lines = np.zeros((21, 104), np.uint8)
    lines[:, :102] = PICTURE[::-1, :, ::-1].reshape(21, -1)
    head = b"BM" + struct.pack("<IIIIiiHHIIiiII", 0, 0, 54, 40, 34, 21, 1, 24, 0, 0, 0, 0, 0, 0)
    assert (images.decode(head + lines.tobytes()) == PICTURE).all()
    for bad in (b"", b"text", b"\x89PNG\r\n\x1a\n", b"BM"):
        with pytest.raises(ValueError):
            images.decode(bad)


def test_resizing_and_network_input():
    flat = np.full((40, 60, 3), 77, np.uint8)
    assert (images.resize(flat, 13, 90) == 77).all() and (images.resize(PICTURE, 21, 34) == PICTURE).all()
    half = images.resize(np.arange(16.0).reshape(4, 4, 1), 2, 2)[..., 0]
    assert half[0, 0] < half[0, 1] < half[1, 0] < half[1, 1] and abs(half.mean() - 7.5) < 1e-9
    x = images.network_input(flat, 16)
    assert x.shape == (3, 16, 16) and np.allclose(x[0], (77 / 255 - 0.485) / 0.229, atol=1e-5)
    assert np.allclose(images.network_input(flat, None, None), 77 / 255) and np.allclose(images.network_input(flat, (8, 9), "half"), 77 / 127.5 - 1, atol=1e-5)


def test_pictures_for_a_model():
    assert images.crop(PICTURE, 4, 3, 10, 9).shape == (6, 6, 3) and images.crop(PICTURE, 50, 50, 90, 90).shape == (1, 1, 3)
    boxed = images.draw_box(PICTURE, 5, 5, 20, 15, width=2)
    changed = (boxed == (255, 0, 0)).all(axis=2)
    assert changed[5, 5] and changed[15, 20] and changed[6, 12] and not changed[8, 8] and not changed[0, 0] and (PICTURE[5, 5] != (255, 0, 0)).any()
    assert images.capped(np.zeros((900, 10, 3), np.uint8)).shape == (448, 4, 3) and images.capped(PICTURE).shape == PICTURE.shape
    assert images.side_by_side(PICTURE, PICTURE[:, :10], 42).shape == (42, 68 + 20, 3)
    assert [x.shape for x in images.shown(PICTURE, [PICTURE] * 2, (2, 2, 8, 6))] == [(21, 34, 3), (4, 6, 3), (21, 34, 3), (21, 34, 3)]
    assert images.thumbnail_hash(PICTURE) == images.thumbnail_hash(images.resize(PICTURE, 21, 34)) != images.thumbnail_hash(PICTURE[::-1])


def test_pictures_of_files(spark):
    df = spark.createDataFrame([(1, bytearray(images.encode_png(PICTURE)), "x"), (2, bytearray(b"no"), "x"), (3, None, "x")], "image_id long, content binary, c string")
    got = {r["image_id"]: r for r in images.pictures(df).collect()}
    assert (got[1]["h"], got[1]["w"], got[1]["thumbnail"]) == (21, 34, images.thumbnail_hash(PICTURE))
    assert got[2]["h"] is None and got[3]["thumbnail"] is None and images.pictures(df.limit(0)).count() == 0


def test_files_are_renamed_once(spark, tmp_path):
    (tmp_path / "a").write_bytes(images.encode_png(PICTURE))
    (tmp_path / "b").write_bytes(b"text")
    (tmp_path / "a.png").write_bytes(b"taken")
    files = spark.createDataFrame([(str(p), bytearray(p.read_bytes()[:16])) for p in sorted(tmp_path.iterdir())], "path string, head binary")
    plan = catalog.repair_plan(files)
    assert [r["renamed"] for r in catalog.apply_repair(plan).collect()] == [True]
    assert sorted(os.listdir(tmp_path)) == ["a.png", "a_1.png", "b"]
    assert [r["renamed"] for r in catalog.apply_repair(plan).collect()] == [False]
