import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pixelmill.operators import codecs, pixels


def _image(h, w, channels, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    return np.dstack([np.clip(100 + 60 * np.sin(x / 5 + c + seed) + y, 0, 255) for c in range(channels)]).astype(np.uint8)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_lossless_round_trips(channels):
    image = _image(19, 31, channels)
    assert np.array_equal(codecs.decode(codecs.encode(image, "png")), image)
    back = codecs.decode(codecs.encode(image, "webp"))
    assert np.array_equal(back[..., :1], image[..., :1])
    if channels == 4:
        assert np.array_equal(back, image)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 4), st.integers(1, 256), st.integers(0, 5))
def test_webp_round_trips(h, w, channels, levels, seed):
    image = np.random.default_rng(seed).integers(0, levels, (h, w, channels)).astype(np.uint8)
    want = np.repeat(image[..., :1], 3, 2) if channels < 3 else image[..., :3]
    want = np.concatenate([want, image[..., -1:]], 2) if channels in (2, 4) else want
    assert np.array_equal(codecs.decode(codecs.encode(image, "webp")), want)


def test_webp_is_compressed():
    for image in (_image(200, 300, 3), np.full((100, 100, 3), 9, np.uint8), np.tile(_image(5, 300, 4), (20, 1, 1))):
        assert len(codecs.encode(image, "webp")) < image.size / 3


def _filtered(image, kinds):
    """A PNG whose rows take these filters in turn."""
    import struct
    import zlib

    h, w, c = image.shape
    rows, up = [], np.zeros((w, c), int)
    for y in range(h):
        cur, left, corner = image[y].astype(int), np.zeros((w, c), int), np.zeros((w, c), int)
        left[1:], corner[1:] = cur[:-1], up[:-1]
        far = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        k = kinds[y % len(kinds)]
        rows.append(bytes([k]) + (cur - [0 * cur, left, up, (left + up) // 2, paeth][k] & 255).astype(np.uint8).tobytes())
        up = cur
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return codecs.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[4], [3], [0, 1, 2, 3, 4], [4, 3, 1], [3, 4, 4, 2]])
@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_filters(kinds, channels):
    image = np.random.default_rng(3).integers(0, 256, (17, 23, channels)).astype(np.uint8)
    assert np.array_equal(codecs.decode(_filtered(image, kinds)), image)


@pytest.mark.parametrize(("h", "w", "channels"), [(33, 45, 3), (8, 8, 1), (70, 41, 3), (64, 130, 1), (1, 1, 3)])
def test_another_library_agrees(spark, h, w, channels):
    """The JVM's own codecs: it reads what is written here, and what it writes, baseline and progressive, is read here."""
    jvm, image = spark._jvm, _image(h, w, channels)
    read = lambda data: jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))

    def png(picture):
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(picture, "png", out)
        return codecs.decode(bytes(out.toByteArray()))

    picture = read(codecs.encode(image, "png"))
    assert np.array_equal(png(picture), image)
    assert np.abs(png(read(codecs.encode(image, "jpg"))).astype(int) - codecs.decode(codecs.encode(image, "jpg"))).max() <= 3
    for mode in ("MODE_DISABLED", "MODE_DEFAULT"):
        writer, out = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next(), jvm.java.io.ByteArrayOutputStream()
        how = writer.getDefaultWriteParam()
        how.setProgressiveMode(getattr(jvm.javax.imageio.ImageWriteParam, mode))
        writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
        writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
        writer.getOutput().flush()
        data = bytes(out.toByteArray())
        assert (b"\xff\xc2" in data) == (mode == "MODE_DEFAULT")
        # The JVM smooths halved colours, this repository repeats them: colours differ a little, brightness does not.
        ours, theirs = codecs.decode(data).astype(int), png(read(data)).astype(int)
        assert ours.shape == theirs.shape and np.abs(ours - theirs).mean() < 3
        if channels == 1:
            assert np.abs(ours - theirs).max() <= 2


def test_jpeg_is_close():
    image = _image(33, 45, 3)
    assert np.abs(codecs.decode(codecs.encode(image, "jpg")).astype(int) - image).mean() < 2
    assert len(codecs.encode(image, "jpg")) < image.size


@pytest.mark.parametrize("data", [b"", b"x" * 30, b"\xff\xd8\xff" + b"z" * 30, codecs.SIGNATURE + b"junk" * 6, b"RIFF0000WEBPVP8 " + b"0" * 30])
def test_broken_data_is_an_error(data):
    with pytest.raises(codecs.CodecError):
        codecs.decode(data)


def test_unknown_format_is_an_error():
    with pytest.raises(codecs.CodecError):
        codecs.encode(_image(2, 2, 3), "gif")


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 60), st.integers(1, 60), st.sampled_from(["triangle", "lanczos3"]), st.integers(0, 255))
def test_constant_images_stay_constant(h, w, new_w, new_h, kernel, value):
    image = np.full((h, w, 3), value, np.uint8)
    out = pixels.processed(image, new_w, new_h, kernel, None, 1.2)
    assert out.shape == (new_h, new_w, 3) and (out == value).all()
    assert np.allclose(pixels.weights(w, new_w, kernel).sum(1), 1)


def test_sizes():
    image = _image(50, 100, 3)
    assert pixels.fitted(image, 40, None, "lanczos3").shape == (20, 40, 3)
    assert pixels.fitted(image, None, 100, "lanczos3").shape == (100, 200, 3)
    assert pixels.fitted(image, 30, 30, "triangle").shape == (30, 30, 3)
    assert np.array_equal(pixels.fitted(image, None, None, "lanczos3"), image)
    assert np.array_equal(pixels.resized(image, 100, 50, "lanczos3"), image)


def test_gray_and_order():
    image = _image(8, 8, 4)
    out = pixels.gray(image)
    want = (image[..., 0].astype(int) * 2126 + image[..., 1].astype(int) * 7152 + image[..., 2].astype(int) * 722) // 10000
    assert np.array_equal(out[..., 0], want) and np.array_equal(out[..., 1], image[..., 3])
    assert np.array_equal(pixels.processed(image, 4, None, "lanczos3", True, 0.7), pixels.blurred(pixels.gray(pixels.fitted(image, 4, None, "lanczos3")), 0.7))
    assert np.array_equal(pixels.processed(image, None, None, "lanczos3", False, 0.0), image)


# Parts of the lossless format that the writer here does not use, from a writer that only the tests have.


def _stream(x, w, h, outermost, cache_bits=0, groups=None, shift=2):
    """Fields (value, bits) of pixels that are numbers, without copies; pixels that the colour cache holds come from it."""
    out = [(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]
    if outermost:
        out += [(0, 1)] if groups is None else [(1, 1), (shift - 2, 3), *_stream([g << 8 for g in groups.reshape(-1).tolist()], groups.shape[1], groups.shape[0], False)]
    own = [0] * len(x) if groups is None else [int(groups[(i // w) >> shift, (i % w) >> shift]) for i in range(len(x))]
    cache, tokens = {}, []
    for p in x:
        at = (p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        tokens.append([280 + at] if cache_bits and cache.get(at) == p else [p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24])
        cache[at] = p
    books = []
    for g in range(max(own) + 1):
        mine = [t for t, o in zip(tokens, own, strict=True) if o == g]
        book = []
        for k, n in enumerate((280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)):
            lengths = codecs._lengths(np.bincount([t[k] for t in mine if len(t) > k], minlength=n), 15)
            out += codecs._spoken(lengths)
            book.append((codecs._canonical(lengths), lengths * ((lengths > 0).sum() > 1)))
        books.append(book)
    for t, g in zip(tokens, own, strict=True):
        out += [(int(books[g][k][0][s]), int(books[g][k][1][s])) for k, s in enumerate(t)]
    return out


def _file(w, h, fields):
    import struct

    head = np.array([(w - 1, 14), (h - 1, 14), (1, 1), (0, 3), *fields], np.int64)
    data = b"\x2f" + np.packbits(codecs._packed(head[:, 0], head[:, 1]), bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _numbers(image):
    x = image.reshape(-1, 4).astype(int)
    return (x[:, 3] << 24 | x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2]).tolist()


@pytest.mark.parametrize("cache_bits", [0, 1, 6])
def test_webp_caches_and_groups(cache_bits):
    image = np.random.default_rng(2).integers(0, 5, (11, 14, 4)).astype(np.uint8) * 50
    for groups in (None, np.array([[0, 1, 0, 2], [2, 0, 1, 1], [1, 1, 2, 0]])):
        data = _file(14, 11, [(0, 1), *_stream(_numbers(image), 14, 11, True, cache_bits, groups)])
        assert np.array_equal(codecs.decode(data), image)


@pytest.mark.parametrize(("colours", "per"), [(1, 8), (2, 8), (4, 4), (13, 2), (17, 1), (200, 1)])
def test_webp_palettes(colours, per):
    rng = np.random.default_rng(colours)
    palette, index = rng.integers(0, 256, (colours, 4)).astype(np.uint8), rng.integers(0, colours, (9, 13))
    steps = np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.uint8))
    padded = np.pad(index, ((0, 0), (0, -13 % per))).reshape(9, -1, per)
    packed = (padded << (np.arange(per) * (8 // per))).sum(2)
    pixels_ = [255 << 24 | int(v) << 8 for v in packed.reshape(-1)]
    fields = [(1, 1), (3, 2), (colours - 1, 8), *_stream(_numbers(steps), colours, 1, False), (0, 1), *_stream(pixels_, packed.shape[1], 9, True)]
    assert np.array_equal(codecs.decode(_file(13, 9, fields)), palette[index])


def test_webp_colour_transform_and_every_predictor():
    rng = np.random.default_rng(8)
    image = np.dstack([_image(10, 60, 3), rng.integers(0, 256, (10, 60)).astype(np.uint8)])
    clamp = lambda v: min(max(v, 0), 255)
    mean = lambda a, b: (a + b) // 2
    modes = np.array([[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 1], [13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 13], [11] * 15])
    left = np.zeros((10, 60, 4), np.uint8)
    for y in range(10):
        for x in range(60):
            here = image[y, x].astype(int)
            if not y or not x:
                guess = [0, 0, 0, 255] if not y and not x else image[y, x - 1] if not y else image[y - 1, x]
            else:
                a, b, c = (image[p].astype(int) for p in ((y, x - 1), (y - 1, x), (y - 1, x - 1)))
                d = (image[y - 1, x + 1] if x < 59 else image[y, 0]).astype(int)
                m = modes[y >> 2, x >> 2]
                whole = a if np.abs(b - c).sum() < np.abs(a - c).sum() else b
                guess = [
                    np.array([0, 0, 0, 255]), a, b, d, c, mean(mean(a, d), b), mean(a, c), mean(a, b), mean(c, b), mean(b, d), mean(mean(a, c), mean(b, d)), whole,
                    np.array([clamp(v) for v in a + b - c]), np.array([clamp(int(v + np.trunc((v - w) / 2))) for v, w in zip(mean(a, b), c, strict=True)]),
                ][m]
            left[y, x] = here - np.array(guess) & 255
    fields = [(1, 1), (0, 2), (0, 3), *_stream([m << 8 for m in modes.reshape(-1).tolist()], 15, 3, False), (0, 1), *_stream(_numbers(left), 60, 10, True)]
    assert np.array_equal(codecs.decode(_file(60, 10, fields)), image)
    factors = rng.integers(0, 256, (3, 15, 3))  # red to blue, green to blue, green to red
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(int)
    f = signed(factors)[np.arange(10)[:, None] >> 2, np.arange(60)[None, :] >> 2]
    r, g, b = (signed(image[..., c]) for c in range(3))
    changed = image.copy()
    changed[..., 0] = r - (f[..., 2] * g >> 5) & 255
    changed[..., 2] = b - (f[..., 1] * g >> 5) - (f[..., 0] * r >> 5) & 255
    table = [255 << 24 | int(p[0]) << 16 | int(p[1]) << 8 | int(p[2]) for p in factors.reshape(-1, 3)]
    fields = [(1, 1), (1, 2), (0, 3), *_stream(table, 15, 3, False), (0, 1), *_stream(_numbers(changed), 60, 10, True)]
    assert np.array_equal(codecs.decode(_file(60, 10, fields)), image)
