import hashlib
import zlib

import numpy as np
import pytest
from graphloom.llm import media, webp


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (13, 9), (3, 40)])
@pytest.mark.parametrize("options", [{}, {"even": True}, {"cache_bits": 5}, {"copies": True}, {"copies": True, "cache_bits": 9}])
def test_round_trips(shape, options):
    rng = np.random.default_rng(sum(shape))
    for top in (2, 4, 17, 256):
        a = rng.integers(0, top, (*shape, 4)).astype(np.uint8)
        a[shape[0] // 2 :] = a[: shape[0] - shape[0] // 2]
        blocks = ((shape[0] + 3) >> 2, (shape[1] + 3) >> 2)
        elements = rng.integers(-128, 128, (*blocks, 4))
        elements[..., 0] = 255
        chains = [(), ((webp.SUBTRACT_GREEN,),), ((webp.PREDICTOR, 2, np.full(blocks, 2)),), ((webp.CROSS_COLOUR, 2, elements), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR, 2, rng.integers(0, 14, blocks)))]
        if len(np.unique(a.reshape(-1, 4), axis=0)) <= 256:
            chains.append(((webp.PALETTE,),))
        for chain in chains:
            assert (webp.decode(webp.encode(a, chain, **options)) == a).all()


def test_a_stream_by_hand():
    # 2 x 1 pixels, no transform, no cache, one group: green is 5 or 9 in one bit each, the rest are single symbols
    bits = "".join([f"{0x2F:08b}"[::-1], f"{1:014b}"[::-1], "0" * 14, "0", "000", "0", "0", "0", "1" + "1" + "1" + f"{5:08b}"[::-1] + f"{9:08b}"[::-1], "1" + "0" + "1" + f"{7:08b}"[::-1], "1" + "0" + "1" + f"{3:08b}"[::-1], "1" + "0" + "1" + f"{255:08b}"[::-1], "1" + "0" + "0" + "0", "10"])
    body = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    body += b"\0" * (len(body) % 2)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(data).tolist() == [[[7, 9, 3, 255], [7, 5, 3, 255]]]


def test_cut_streams_raise():
    data = webp.encode(np.arange(4 * 8 * 8, dtype=np.uint8).reshape(8, 8, 4))
    for n in (0, 10, 25, len(data) - 9):
        with pytest.raises(webp.Corrupt):
            webp.decode(data[:n])


def test_media_columns(awkward, nothing):
    rows = {(r.doc_id, r.n_bytes): r for r in media.round_trip(awkward).collect()}
    for r in awkward.collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        got = rows[r.doc_id, len(raw)]
        assert (got.payload_sha256, got.payload_bytes, got.tail_crc32) == (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-16:]))
    images = media.read(media.store(awkward.select("doc_id", "text", "row"))).collect()
    assert all(len(i.pixels) == 4 * i.width * i.height for r in images for i in r.image)
    assert media.round_trip(nothing).count() == 0


def test_long_payloads_take_several_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 3)
    stored, n = media.to_media(b"ab" * 1000)
    assert len(list(media.images(stored))) == 4 and media.from_media(stored).rstrip(b" ") == b"ab" * 1000 and n == 2112


def test_stored_form_is_compressed_and_read_back():
    raw = ("the same line again and again, é\n" * 200).encode()
    stored, size = media.to_media(raw)
    assert media.from_media(stored)[: len(raw)] == raw and len(stored) < size / 4


@pytest.mark.parametrize("window", [16, 40])
def test_streams_are_read_across_windows(monkeypatch, window):
    monkeypatch.setattr(webp, "WINDOW", window)
    rng = np.random.default_rng(7)
    a = rng.integers(0, 9, (20, 30, 4)).astype(np.uint8)
    a[10:] = a[:10]
    for options in ({"copies": True}, {"cache_bits": 4}, {"copies": True, "cache_bits": 6}):
        assert (webp.decode(webp.encode(a, ((webp.SUBTRACT_GREEN,),), **options)) == a).all()
    text = bytes(rng.integers(0, 200, 3000).astype(np.uint8)) * 2
    stored, _ = media.to_media(text)
    assert media.from_media(stored)[: len(text)] == text and len(stored) < len(text)


def test_copies_are_earlier_bytes():
    rng = np.random.default_rng(3)
    for top, n in ((2, 500), (4, 3000), (200, 900), (1, 9000), (3, 5)):
        plane = rng.integers(0, top, n).astype(np.uint8)
        end = 0
        for start, length, back in webp._copies(plane).tolist():
            assert start >= end and 1 <= length <= webp.LONGEST and 1 <= back <= start
            assert all(plane[k] == plane[k - back] for k in range(start, start + length))
            end = start + length
        assert end <= n


def test_the_transform_follows_the_content(monkeypatch):
    seen = []
    encode = webp.encode
    monkeypatch.setattr(webp, "encode", lambda pixels, transforms, **more: seen.append(transforms[0][0]) or encode(pixels, transforms, **more))
    for text in ("", "aab" * 400, "The quick brown fox jumps over the lazy dog, twice.", "é" * 90000 + "abcdefghijklmnopqrst"):
        raw = text.encode()
        stored, size = media.to_media(raw)
        assert media.from_media(stored) == raw.ljust(size, b" ")
    assert set(seen) == {webp.PALETTE, webp.SUBTRACT_GREEN}
