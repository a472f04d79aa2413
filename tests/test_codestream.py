"""Headers, entropy codes, lossless streams and whole codestreams: what is written is read back; bad bytes are refused."""

import random

import numpy as np
import pytest

from tessera.functions import codestream, entropy, headers, histograms, integer, modular
from tessera.functions.dialect import SPARK
from tessera.sources import codestream as source


def through(bundle, given, *more):
    w = entropy.BitWriter()
    written = bundle(headers.Write(w), given, *more)
    w.align()
    r = entropy.BitReader(w.bytes())
    read = bundle(headers.Read(r), None, *more)
    assert not r.overread and read == written
    return read


@pytest.mark.parametrize("size", [(1, 1), (3000, 2000), (513, 257), (64, 64), (2**29, 7), (256, 8), (8, 256), (1920, 1080)])
def test_sizes(size):
    assert through(headers.size_header, {"width": size[0], "height": size[1]}) == {"width": size[0], "height": size[1]}


def test_golden_size_bits():
    """256 x 256 by hand: small, 31 for 32 eighths, ratio 1; nine bits in all."""
    w = entropy.BitWriter()
    headers.size_header(headers.Write(w), {"width": 256, "height": 256})
    assert w.size == 9 and w.bytes() == bytes([1 | 31 << 1 | (1 & 3) << 6, 0])


def full_image():
    alpha = {"type": 0, "depth": {"bits": 8, "exp_bits": 0}, "dim_shift": 3, "name": "ä", "associated": True}
    spot = {"type": 2, "spot": [0.5, 0.25, 1.0, 0.125], "depth": {"bits": 32, "exp_bits": 8}, "dim_shift": 0, "name": ""}
    colour = {"space": 0, "white": 2, "white_xy": {"x": 312700, "y": -5}, "primaries": 2, "primaries_xy": [{"x": 640000, "y": 330000}] * 3, "has_gamma": True, "gamma": 4545455}
    animation = {"tps_num": 24000, "tps_den": 1001, "loops": 0, "timecodes": True}
    meta = {"orientation": 3, "depth": {"bits": 16, "exp_bits": 0}, "xyb": False, "extra": [alpha, spot], "colour": colour, "animation": animation}
    return {"size": {"width": 300, "height": 200}, "meta": meta | {"preview": {"width": 30, "height": 20}}, "custom": {"up2": [0.5] * 15}}


def test_image_and_frame_headers():
    image = through(headers.codestream_header, full_image())
    assert image["meta"]["extra"][1]["spot"][3] == 0.125 and image["meta"]["preview"] == {"width": 30, "height": 20}
    frame = {"type": 0, "modular": True, "crop": {"x": -3, "y": 5, "width": 20, "height": 30}, "blend": {"mode": 2, "clamp": True, "source": 1}, "duration": 7, "is_last": False, "save_as": 2, "name": "one", "timecode": 5, "filter": {"gaborish": False, "passes": 0}}
    got = through(headers.frame_header, frame, image)
    assert got["crop"] == frame["crop"] and got["save_as"] == 2 and got["blend"]["clamp"]
    passes = {"n": 3, "shifts": [2, 1, 0], "downsample": [4, 2], "last": [0, 1]}
    got = through(headers.frame_header, {"modular": False, "passes": passes, "filter": {"gaborish": True, "weights": [0.125] * 6, "passes": 1}}, image)
    assert headers.shift_brackets(got["passes"]) == [(2, 2), (1, 1), (0, 0)]
    assert through(headers.image_metadata, {}) == through(headers.image_metadata, {"orientation": 1})


def test_extensions_are_skipped():
    w = entropy.BitWriter()
    entropy.write_u64(w, 0b101)
    entropy.write_u64(w, 7)
    entropy.write_u64(w, 9)
    w.write(0xFFFF, 16)
    w.write(5, 3)
    r = entropy.BitReader(w.bytes())
    assert headers.extensions(headers.Read(r))["extensions"] == 5 and r.read(3) == 5


def test_frames_of_too_many_samples():
    image = {"size": {"width": 1 << 20, "height": 1 << 20}}
    with pytest.raises(ValueError):
        headers.frame_grid(image, {"crop": None, "type": 0, "upsampling": 1, "group_shift": 1, "passes": {"n": 1}})


@pytest.mark.parametrize("prefix", [False, True])
def test_numbers_round_trip(prefix):
    rng = random.Random(1)
    for _ in range(120):
        contexts, n, mean = rng.choice([1, 2, 3, 7, 40]), rng.choice([0, 1, 2, 5, 100, 700]), rng.choice([0.3, 2, 10, 100, 5000, 1 << 20])
        numbers = [(rng.randrange(contexts), int(rng.expovariate(1 / mean))) for _ in range(n)]
        numbers = [(c, v + 17 * c) for c, v in numbers]
        w = entropy.BitWriter()
        w.write(5, 3)
        histograms.write_numbers(w, numbers, contexts, prefix)
        w.write(42, 7)
        r = entropy.BitReader(w.bytes())
        assert r.read(3) == 5
        reader = histograms.NumberReader(histograms.read_code(r, contexts), r)
        assert [reader.read(c) for c, _ in numbers] == [v for _, v in numbers]
        reader.check()
        assert r.read(7) == 42


def test_numbers_take_about_their_entropy():
    rng = random.Random(2)
    numbers = [(0, min(15, int(rng.expovariate(0.5)))) for _ in range(20_000)]
    n = [sum(v == k for _, v in numbers) for k in range(16)]
    bits = sum(c * np.log2(len(numbers) / c) for c in n if c)
    w = entropy.BitWriter()
    histograms.write_numbers(w, numbers, 1)
    assert bits <= w.size <= 1.01 * bits + 400


def test_alias_tables_give_every_symbol_its_count():
    rng = random.Random(3)
    for log in (5, 6, 8):
        histogram = [rng.choice([0, 1, 5, 1000]) for _ in range(1 << log)]
        counts = entropy.normalised(histogram) if any(histogram) else [4096]
        table = histograms.Alias.of(counts, log)
        met = [table.lookup(v) for v in range(4096)]
        assert len(set(met)) == 4096
        for symbol, c in enumerate(counts):
            assert sorted(place for s, place in met if s == symbol) == list(range(c))


def test_copies_are_expanded():
    """Six literals, then a copy of nine from three back: distance 2 + 1 where rows have no width."""
    hybrid = histograms.Hybrid(4, 0, 0)
    copies = histograms.Copies(224, 3, histograms.Hybrid(0, 0, 0))
    lengths = [0] * 300
    for k, n in {0: 2, 1: 2, 2: 2, 224 + 3: 2}.items():
        lengths[k] = n
    code = histograms.Code([0, 1], [hybrid, hybrid], 15, prefixes=[histograms.Prefix(lengths), histograms.Prefix([0, 0, 1])], copies=copies)
    w = entropy.BitWriter()
    histograms.write_code(w, code, 1)
    for v in (0, 1, 2, 2, 1, 0):
        code.prefixes[0].write(w, v)
    code.prefixes[0].write(w, 227)  # token 3 of the lengths: 4 and two raw bits
    w.write(2, 2)
    r = entropy.BitReader(w.bytes())
    reader = histograms.NumberReader(histograms.read_code(r, 1), r)
    assert [reader.read(0) for _ in range(15)] == [0, 1, 2, 2, 1, 0, 2, 1, 0, 2, 1, 0, 2, 1, 0]
    assert histograms.copy_distance(0, 10) == 10 and histograms.copy_distance(1, 10) == 1 and histograms.copy_distance(121, 10) == 2


def test_context_maps():
    rng = random.Random(4)
    for contexts in ([0] * 5, [rng.randrange(3) for _ in range(20)] + [0, 1, 2], list(range(12)) + [rng.randrange(12) for _ in range(200)]):
        w = entropy.BitWriter()
        histograms.write_context_map(w, contexts)
        assert histograms.read_context_map(entropy.BitReader(w.bytes()), len(contexts)) == contexts
    w = entropy.BitWriter()
    histograms.write_context_map(w, [0, 2, 2])
    with pytest.raises(ValueError):
        histograms.read_context_map(entropy.BitReader(w.bytes()), 3)


def test_colour_transforms_agree_with_the_formulas():
    c = [np.array([7, 200, 0]), np.array([90, 3, 255]), np.array([31, 64, 2])]
    for kind in range(42):
        got = modular.colour_forward(c, kind)
        for k, text in enumerate(integer.rct_forward(SPARK, kind)):
            for i in range(3):
                names = {f"c{j}": int(c[j][i]) for j in range(3)} | {"shiftright": lambda a, n: a >> n, "cast": int}
                plain = text.replace(" as bigint", "").replace(" as int", "")
                assert eval(plain, {"__builtins__": {}}, names) == got[k][i]  # noqa: S307  the repository's own formula
        assert all((a == b).all() for a, b in zip(modular.colour_inverse(got, kind), c, strict=True))


def test_tendency_keeps_pairs_monotone():
    """By search: the step is the rounded twelfth, or the largest that keeps both samples within the neighbours."""
    rng = np.random.default_rng(5)
    b, a, n = rng.integers(0, 60, (3, 3000))
    t = modular.tendency(b, a, n)
    falls, rises = (b >= a) & (a >= n), (b <= a) & (a <= n)
    assert (t[~(falls | rises)] == 0).all() and (t[falls] >= 0).all() and (t[rises & ~falls] <= 0).all()
    assert (modular.tendency(-b, -a, -n) == -t).all()
    first = a + (t - np.sign(t) * (np.abs(t) & 1)) // 2
    second = first - t
    assert (np.abs(first - a)[falls] <= (b - a)[falls]).all() and (second[falls] >= n[falls]).all()


def test_squeezes_round_trip():
    rng = np.random.default_rng(6)
    for h, w in ((1, 1), (2, 9), (5, 16), (7, 3)):
        v = rng.integers(-300, 300, (h, w))
        assert (modular.squeeze_inverse(*modular.squeeze_forward(v)) == v).all()


def pictures(rng, h, w):
    y, x = np.mgrid[:h, :w]
    wave = np.clip(127 + 90 * np.sin(x / 9) + 30 * np.cos(y / 5) + rng.normal(0, 2, (h, w)), 0, 255)
    return [(x + 37 * y) % 256, rng.integers(0, 256, (h, w)), np.full((h, w), 85), np.where((x + y) % 2, 255, 0), wave.astype(np.int64), rng.integers(0, 3, (h, w)) * 100]


def test_streams_round_trip_with_every_predictor_property_and_transform():
    rng, r = np.random.default_rng(3), random.Random(2)
    for trial in range(56):
        h, w = r.choice([(1, 1), (3, 5), (17, 1), (12, 23)])
        n = r.choice([1, 3, 4])
        given = [r.choice(pictures(rng, h, w)).astype(np.int64) for _ in range(n)]
        layout, steps = modular.Layout([modular.Channel(v.copy()) for v in given]), []
        if n >= 3 and trial % 2:
            steps.append({"kind": 0, "begin": 0, "type": r.randrange(42)})
            modular.apply_forward(layout, steps[-1])
        if trial % 5 == 2 and (found := modular.palette_forward(layout, 0, 1)):
            steps.append(found)
        elif trial % 5 == 4:
            steps.append({"kind": 2, "steps": []})
            modular.apply_forward(layout, steps[-1])
        leaf = modular.Node(predictor=trial % 14, offset=r.randint(-5, 5))
        tree = [modular.Node(property=r.randrange(24), split=r.randint(-3, 30), above=1, below=2), leaf, modular.Node(predictor=6)]
        weights = None if trial % 3 else {"p1": 3, "p2": 30, "p3": [1, 2, 3, 4, 5], "w": [1, 2, 3, 15]}
        out = entropy.BitWriter()
        modular.write_channels(out, layout, 7, tree, steps, weights, bool(trial % 4 == 1))
        out.write(9, 5)
        reader = entropy.BitReader(out.bytes())
        blank = modular.Layout([modular.Channel(np.zeros((h, w), np.int64)) for _ in range(n)])
        header = modular.read_channels(reader, blank, 7)
        assert reader.read(5) == 9
        modular.undo(blank, header["transforms"], header["weights"])
        assert len(blank.channels) == n and all((a.v == b).all() for a, b in zip(blank.channels, given, strict=True))


def test_delta_palettes():
    """Indexes below the number of deltas add to the prediction from what is already there."""
    layout = modular.Layout([modular.Channel(np.array([[5, 100]])), modular.Channel(np.array([[1, 0, 0], [0, 1, 0]]))], meta=1)
    modular.palette_inverse(layout, {"kind": 1, "begin": 0, "n": 1, "colours": 1, "deltas": 1, "predictor": 1}, modular.USUAL_WEIGHTS)
    assert layout.channels[0].v.tolist() == [[100, 105, 110], [105, 100, 105]]


def test_images_round_trip():
    rng = np.random.default_rng(8)
    for h, w, n, bits, shift in ((1, 1, 1, 8, 1), (40, 30, 3, 8, 1), (20, 30, 4, 16, 1), (150, 70, 3, 8, 0), (129, 140, 1, 12, 0)):
        planes = [(pictures(rng, h, w)[k % 6].astype(np.int64) << (bits - 8)) for k in range(4, 4 + n)]
        image, got = codestream.read_image(codestream.write_image(planes, bits, shift))
        assert image["size"] == {"height": h, "width": w} and len(got) == n
        assert all((a == b).all() for a, b in zip(got, planes, strict=True))


def test_permuted_sections_and_profiles():
    plane = np.arange(130 * 5).reshape(130, 5) % 256
    image = codestream.lossless_header(5, 130, 1, 8)
    image["meta"]["colour"]["want_icc"] = True
    grid = {"dc_groups": 1, "groups": 2}
    groups = [codestream.group_bytes([v], codestream.group_stream(grid, k)) for k, v in enumerate((plane[:128], plane[128:]))]
    profile = bytes(range(256)) + b"mntrRGB XYZ "
    data = codestream.assemble(image, codestream.lossless_frame(0), [codestream.dc_global_bytes(), b"", b"", *groups], [4, 2, 3, 0, 1], profile)
    heads, found, frames = codestream.read_heads(data)
    assert found == profile and sum(n for _, n in frames[0].sections) == frames[0].end - min(at for at, _ in frames[0].sections)
    assert (codestream.read_planes(data, heads, frames[0])[0] == plane).all()


def test_damaged_streams_are_refused_or_read():
    rng = random.Random(9)
    data = codestream.write_image([pictures(np.random.default_rng(1), 24, 20)[4]])
    for _ in range(150):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(2, len(bad))] ^= 1 << rng.randrange(8)
        try:
            codestream.read_image(bytes(bad[: rng.choice([len(bad), rng.randrange(2, len(bad))])]))
        except (ValueError, OverflowError, IndexError, KeyError, MemoryError):
            pass


def test_images_in_tables(spark):
    """Groups of two images of different sizes, written and read as tables; sections tile their files."""
    rng = np.random.default_rng(11)
    given = {1: [pictures(rng, 150, 40)[4]], 2: [pictures(rng, 30, 20)[k] for k in (0, 4, 5)]}
    rows = [(img, c, y, [int(x) for x in row]) for img, planes in given.items() for c, v in enumerate(planes) for y, row in enumerate(v)]
    files = source.encode(spark.createDataFrame(rows, "img long, c int, y long, row array<int>").repartition(5), group_shift=0)
    got = {(r.img, r.c, r.y): list(r.row) for r in source.decode(files).collect()}
    assert got == {(img, c, y): row for img, c, y, row in rows}
    frames = {r.file: r for r in source.frame_rows(files).collect()}
    assert [s.role for s in frames[1].sections] == ["dc_global", "dc_group", "ac_global", "ac_group", "ac_group"] and [s.role for s in frames[2].sections] == ["all"]
    cut = source.section_data(files).collect()
    assert all(len(r.data) == r.size for r in cut)
    bad = spark.createDataFrame([(1, b"no image"), (2, None)], "file long, data binary")
    assert [r.width for r in source.image_info(bad).collect()] == [None, None]
