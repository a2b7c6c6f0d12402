import random
import struct
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwise.config import DedupConfig, parse_size
from foldwise.functions import codecs, hashes, jpeg, tans, vcdiff
from foldwise.operators import delta, sketch
from foldwise.sources import rendered

blocks = st.lists(st.lists(st.integers(-1023, 1023) | st.just(0), min_size=64, max_size=64), max_size=4)


@given(blocks)
@settings(max_examples=50, deadline=None)
def test_residual_container_round_trip(rows):
    own = np.array(rows, np.int64).reshape(-1, 64)
    assert (codecs.unpack_residual(codecs.pack_residual(own)) == own).all()


def test_run_length_edges():
    assert codecs.run_lengths(np.zeros((1, 64), int)) == [(0, 0)]
    far = np.zeros((1, 64), int)
    far[0, codecs.ZIGZAG[20]] = 5
    assert codecs.run_lengths(far) == [(15, 0), (4, 5), (0, 0)]
    last = np.zeros((1, 64), int)
    last[0, 63] = -1
    assert codecs.run_lengths(last)[-1] == (15, -1)


def test_magnitudes():
    for value, size in ((-1, 1), (1, 1), (-4095, 12), (4095, 12), (0, 0)):
        assert codecs.magnitude(value)[0] == size
        assert codecs.extend(codecs.magnitude(value)[1], size) == value


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_byte_delta_and_adler(a, b):
    assert codecs.undelta_bytes(a, codecs.delta_bytes(a, b)) == b
    assert hashes.adler32_combine(hashes.adler32(a), hashes.adler32(b), len(b)) == hashes.adler32(a + b)


@st.composite
def edited(draw):
    """A text, and two more made from it by cutting, copying, inserting and repeating."""
    texts = [draw(st.binary(max_size=400) | st.text("ab ", max_size=400).map(str.encode))]
    for _ in range(2):
        own = bytearray(texts[-1])
        for _ in range(draw(st.integers(0, 5))):
            i, j, n = (draw(st.integers(0, len(own))) for _ in range(3))
            kind = draw(st.sampled_from("cdir"))
            own[i:i] = own[j : j + n] if kind == "c" else draw(st.binary(max_size=30)) if kind == "i" else bytes([n % 256]) * (n % 40) if kind == "r" else b""
            if kind == "d":
                del own[i : i + n]
        texts.append(bytes(own))
    return texts


@given(edited())
@settings(max_examples=200, deadline=None)
def test_byte_deltas_restore_and_compose(texts):
    a, b, c = texts
    one, two = vcdiff.encode(a, b), vcdiff.encode(b, c)
    assert vcdiff.decode(a, one) == b and vcdiff.decode(b, two) == c
    assert vcdiff.decode(a, vcdiff.compose(one, two)) == c
    assert codecs.undelta_bytes(a, codecs.composed_delta(codecs.delta_bytes(a, b), codecs.delta_bytes(b, c))) == c


def test_a_match_anywhere_in_a_long_base_is_found():
    base = random.Random(4).randbytes(300_000)
    target = base[250_000:] + base[:120_000]
    assert len(vcdiff.encode(base, target)) < 60
    assert vcdiff.decode(base, vcdiff.encode(base, target)) == target


def test_the_instruction_table_and_a_window_byte_by_byte():
    assert len(vcdiff.TABLE) == 256 and vcdiff.TABLE[0] == (("run", 0, 0),) and vcdiff.TABLE[18] == (("add", 17, 0),)
    assert vcdiff.TABLE[19] == (("copy", 0, 0),) and vcdiff.TABLE[163] == (("add", 1, 0), ("copy", 4, 0)) and vcdiff.TABLE[255] == (("copy", 4, 8), ("add", 1, 0))
    # source abcdefghijklmnop: copy 16 from 0, add "xy", run of 5 z
    assert vcdiff.pack([("copy", 0, 16), ("add", b"xy"), ("run", ord("z"), 5)], 16, None) == b"\xd6\xc3\xc4\0\0\x01\x10\x00\x0d\x17\x00\x03\x04\x01xyz\x20\x03\x00\x05\x00"


@given(st.binary(max_size=300) | st.text("aaaaab", max_size=3000).map(str.encode))
@settings(max_examples=100, deadline=None)
def test_entropy_coder_round_trip(data):
    packed, coded = codecs.entropy_code(data)
    assert codecs.entropy_decode(packed, coded) == data and len(packed) <= len(data)


@given(st.lists(st.integers(0, 1000), min_size=2, max_size=256).filter(lambda c: sum(x > 0 for x in c) > 1), st.integers(9, 12))
@settings(max_examples=200, deadline=None)
def test_scaled_counts_fill_the_table(counts, log):
    norm = tans.scaled(np.array(counts), log)
    assert np.abs(norm).sum() == 1 << log and ((norm != 0) == (np.array(counts) > 0)).all()


def test_geometric_bytes_are_coded_near_their_entropy():
    rng = random.Random(5)
    data = bytes(min(255, int(rng.expovariate(0.2))) for _ in range(20_000))
    share = np.bincount(np.frombuffer(data, np.uint8)) / len(data)
    bits = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert len(tans.encode(data)) < len(data) * bits / 8 * 1.02 + 200


def test_adler_rolls():
    data = bytes(random.Random(1).randbytes(50))
    one = hashes.adler32(data[:16])
    for i in range(16, 50):
        one = hashes.adler32_roll(one, data[i], data[i - 16], 16)
        assert one == hashes.adler32(data[i - 15 : i + 1])


def test_rabin_and_gear_depend_on_their_window_only():
    rng = random.Random(2)
    a, b = rng.randbytes(100), rng.randbytes(70)
    rabin = hashes.Rabin(16)
    assert (rabin.windows(a)[-1:] == rabin.windows(b + a)[-1:]).all()
    rabin.reset()
    assert [rabin.slide(x) for x in a][15:] == rabin.windows(a).tolist()
    block = np.frombuffer(rng.randbytes(3 * 4 * 128), np.uint8).reshape(3, 4, 128)
    square, found = hashes.Rabin(4 * 128), []
    for y in range(2):
        for x in range(3):
            square.reset()
            found.append([square.slide(int(v)) for c in (x, x + 1) for r in (y, y + 1) for v in block[r, c]][-1])
    assert square.grids(block, 2).tolist() == found
    halves = [hashes.gear(a[:64])[-1], hashes.gear(a[64:100] + b[:28])[-1]]
    assert hashes.gear_blocks(np.frombuffer(a[:100] + b[:28], np.uint8)).tolist() == [sum(map(int, halves)) % (1 << 64)]
    assert hashes.gear(a)[-1] == hashes.gear(b + a)[-1]
    h = 0
    for x in a:
        h = ((h << 1) + int(hashes.GEAR[x])) % (1 << 64)
    assert h == int(hashes.gear(a)[-1])


def grids(base, target):
    return [list(r) for r in base.split("/")], [list(r) for r in target.split("/")]


@pytest.mark.parametrize(
    ("base", "target", "fixed", "copies", "inserts", "residual"),
    [
        ("ABCDE", "ABXDE", True, [(0, 0, 2), (3, 0, 2)], [0, 1], ["X"]),
        ("ABCDE", "ABXDE", False, [(0, 0, 2), (3, 0, 2)], [0, 1], ["X"]),
        ("ABCDE", "ABCDX", True, [(0, 0, 4)], [0, 1], ["X"]),
        ("ABC", "ZABC", True, [], [4], list("ZABC")),
        ("ABC", "ZABC", False, [(0, 0, 3)], [1], ["Z"]),
        ("AAAB", "AAB", False, [(1, 0, 3)], [0], []),
    ],
)
def test_instructions(base, target, fixed, copies, inserts, residual):
    one, two = grids(base, target)
    assert delta.instructions(one, two, fixed) == (copies, inserts, residual)


def test_collapsed_index_reaches_the_head_of_a_run_only():
    one, two = grids("AAAB", "AAB")
    assert delta.instructions(one, two, collapse_runs=True)[0] == [(0, 0, 2), (3, 0, 1)]


@given(st.text("ABC/", max_size=40), st.text("ABC/", max_size=40), st.booleans())
def test_replay_restores(base, target, fixed):
    one, two = grids("/".join(x for x in base.split("/") if x) or "A", "/".join(x for x in target.split("/") if x) or "A")
    assert delta.replay(one, [len(r) for r in two], *delta.instructions(one, two, fixed)) == two


def test_options():
    assert [parse_size(x) for x in ("2G", "16M", "4K", "7")] == [2 << 30, 16 << 20, 4096, 7]
    assert DedupConfig.from_options({"sf_num": "8", "patch_size": "1M", "collapse_runs": "yes"}).patch_size == 1 << 20
    for bad in ({"feature_method": "gear"}, {"sf_num": 40, "sf_component_num": 2}, {"block_size": 1}):
        with pytest.raises(ValueError):
            DedupConfig(**bad)


def _header(sampling, ends, restart):
    """Tables, frame and scan; the code of a block's end has four bits, and what it is in the tables of the other planes is for ``ends`` to say."""
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    others = [0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    tables = b"".join(segment(0xC4, bytes([0x10 | i, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 161, 0, 0, 0, 0, symbols[0], *symbols[1:]])) for i, symbols in enumerate(([0, *others], [others[ends], 0, *others[:ends], *others[ends + 1 :]])))
    first = b"".join(segment(0xC4, bytes([i, 0, 0, 0, 12, *[0] * 12, *(range(12) if not i else range(11, -1, -1))])) for i in range(2))
    frame = struct.pack(">BHHB", 8, 70, 90, 3) + bytes([1, sampling, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + segment(0xC0, frame) + tables + first + (segment(0xDD, struct.pack(">H", restart)) if restart else b"") + segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))


@pytest.mark.parametrize("restart", [0, 5])
@pytest.mark.parametrize("sampling", [0x11, 0x22, 0x21])
def test_images_of_equal_blocks_and_other_tables(sampling, restart):
    # blocks and their first tables are the same in both files, the tables of the other planes are not
    rng = np.random.default_rng(sampling)
    h, v = divmod(sampling, 16)
    down, across = -(-70 // (8 * v)), -(-90 // (8 * h))
    few = rng.integers(-40, 40, (3, 64)) * (rng.random((3, 64)) < 0.2)
    few[1, 63] = 7
    planes = [few[rng.integers(0, 3, (down * y, across * x))].astype(np.int16) for x, y in ((h, v), (1, 1), (1, 1))]
    planes[1][::2] = planes[2][:, ::2] = 0
    for ends in (0, 9, 0):
        image = jpeg.Coefficients(_header(sampling, ends, restart), planes, b"")
        data = jpeg.encode(image)
        assert all((p == q).all() for p, q in zip(jpeg.decode(data).planes, planes, strict=True))
        assert jpeg.encode(jpeg.decode(data)) == data
        with pytest.raises(jpeg.Damaged):
            jpeg.decode(data[: len(image.header) + 40] + b"\xff\xd9" if not restart else data[:-42] + b"\xff\xd9")


def test_a_long_text_is_rendered_read_and_written_in_a_moment():
    # a symbol at a time, these 20000 words took a second
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(2000)}" for _ in range(20_000))
    times = []
    for _ in range(3):
        began = time.process_time()
        data = rendered.image(text)
        assert jpeg.encode(jpeg.decode(data)) == data
        times.append(time.process_time() - began)
    assert min(times) < 0.4


def _texts(n):
    rng = random.Random(n)
    return [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 400 if i % 20 else 3000))) for i in range(n)] + ["", "\n\n", "w " * 127 + "w", "w " * 128]


def test_texts_rendered_together_are_files_of_their_own():
    texts = _texts(50)
    for text, data in zip(texts, rendered.made(texts), strict=True):
        words = text.replace("\n", " ").split(" ")
        planes = [np.zeros((max(8, -(-len(words) // 16)), 16, 64), np.int16) for _ in range(3)]
        planes[0].reshape(-1, 64)[: len(words), codecs.ZIGZAG[:9]] = rendered.blocks(words)
        assert jpeg.encode(jpeg.Coefficients(rendered.header(len(planes[0])), planes, b"")) == data


@pytest.mark.parametrize("restart", [0, 5])
@pytest.mark.parametrize("sampling", [0x11, 0x22])
def test_files_read_side_by_side(sampling, restart):
    # values of up to 15 bits, subsampling, other tables, damage, and lengths that few others have
    rng, own = np.random.default_rng(sampling), []
    h, v = divmod(sampling, 16)
    down, across = -(-70 // (8 * v)), -(-90 // (8 * h))
    for i in range(60):
        most = 2 ** rng.integers(1, 10)
        planes = [(rng.integers(-most, most, (down * y, across * x, 64)) * (rng.random((down * y, across * x, 64)) < rng.random())).astype(np.int16) for x, y in ((h, v), (1, 1), (1, 1))]
        own.append(jpeg.encode(jpeg.Coefficients(_header(sampling, 9 * (i % 2), restart), planes, b"")))
    own += rendered.made(_texts(200))
    for data in own[:]:
        hurt, at = bytearray(data), int(rng.integers(2, len(data) - 2))
        hurt[at] ^= 1 << int(rng.integers(8))
        own += [bytes(hurt), data[:at] + b"\xff\xd9"]
    read = dict(jpeg.decoded(own))
    assert sorted(read) == list(range(len(own)))
    for i, data in enumerate(own):
        try:
            alone = jpeg.decode(data)
        except jpeg.UNREADABLE:
            alone = None
        assert (read[i] is None) == (alone is None)
        if alone:
            assert (read[i].header, read[i].tail) == (alone.header, alone.tail)
            assert all(np.array_equal(p, q) for p, q in zip(read[i].planes, alone.planes, strict=True))


def test_images_sketched_together():
    rng = np.random.default_rng(4)
    images = [([p for p in jpeg.decode(data).planes], data) for data in rendered.made(_texts(40))]
    images += [([(rng.integers(-300, 300, (9, 11, 64)) * (rng.random((9, 11, 64)) < 0.3) * (np.arange(64) < n)).astype(np.int16)], b"xyz" * 50) for n in (64, 32, 33)]
    shapes = [("2df", 2, 2), ("2df", 2, 4), ("2df", 1, 2), ("2df", 1, 3), ("rabin", 2, 2), ("rabin", 2, 3), ("rabin", 1, 1), ("rabin", 1, 16), ("rabin", 1, 64), ("rabin", 1, 100), ("rabin", 3, 1), ("rabin", 3, 2), ("gear", 1, 2), ("gear", 3, 2)]
    configs = [DedupConfig(feature_method=m, dimension=d, block_size=b, sf_num=4, sf_component_num=n, data_type=kind) for m, d, b in shapes for n in (1, 3) for kind in ("decoded", "raw")]
    configs.append(DedupConfig(uniform_sample=True))
    for (planes, data), found in zip(images, sketch.first_super_features(images, configs), strict=True):
        assert found == [sketch.exact_sketch(planes, data, c)["sf"][0] for c in configs]


def test_many_texts_are_rendered_read_and_sketched_in_a_moment():
    # one by one, these 220000 words took three seconds of CPU
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(440)) for _ in range(500)]
    configs = [DedupConfig(feature_method=m, dimension=d, block_size=b) for m, d, b in (("2df", 2, 2), ("2df", 1, 2), ("rabin", 2, 2), ("rabin", 1, 16), ("rabin", 3, 2), ("gear", 1, 2), ("gear", 3, 2))]
    times = []
    for _ in range(2):
        began = time.process_time()
        files = rendered.made(texts)
        sketch.first_super_features([(image.planes, files[i]) for i, image in jpeg.decoded(files)], configs)
        times.append(time.process_time() - began)
    assert min(times) < 1.2


def test_matching_looks_at_every_block_of_the_base_once():
    rng = random.Random(9)
    data = np.frombuffer(rng.randbytes(1000), np.uint8)
    for n, step in ((16, 16), (4, 1), (16, 7), (1000, 16), (1001, 16)):
        # all places were hashed, and one in sixteen was kept
        assert (vcdiff._rolling(data, n, step) == vcdiff._rolling(data, n)[::step]).all()
    for i, j, most in ((0, 0, 0), (3, 40, 1), (0, 7, 63), (5, 5, 64), (1, 2, 300), (9, 700, 3000)):
        same = rng.randbytes(most)
        assert vcdiff._common(bytes(i) + same + b"a" + bytes(most), i, bytes(j) + same + b"b", j) == most
        assert vcdiff._common(bytes(i) + same, i, bytes(j) + same, j) == most
    # runs of zeros, as the coefficients of images have, with something between
    base = b"".join(bytes(rng.randrange(200)) + rng.randbytes(rng.randrange(30)) for _ in range(300))
    for _ in range(20):
        at = rng.randrange(len(base))
        target = base[at:] + bytes(rng.randrange(100)) + base[: at // 2] + rng.randbytes(9)
        assert vcdiff.decode(base, vcdiff.encode(base, target)) == target
