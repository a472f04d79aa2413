"""Sequential codes, containers, image files and streams: round trips and hand-worked cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import entropy
from tessera.functions.dialect import PLAIN
from tessera.functions.integer import predictors, smooth_tendency
from tessera.operators import codec, compose, lossless, planes
from tessera.sources import container, netpbm
from tessera.streaming import animation


@given(st.lists(st.tuples(st.integers(0, 56), st.integers(0, 2**56 - 1)), max_size=30))
def test_bits(pairs):
    w = entropy.BitWriter()
    for n, v in pairs:
        w.write(v & ((1 << n) - 1), n)
    r = entropy.BitReader(w.bytes())
    assert [r.read(n) for n, _ in pairs] == [v & ((1 << n) - 1) for n, v in pairs]
    assert not r.overread and r.read(64) >= 0 and r.overread


@given(st.integers(0, 2**64 - 1))
def test_u64(v):
    w = entropy.BitWriter()
    entropy.write_u64(w, v)
    assert entropy.read_u64(entropy.BitReader(w.bytes())) == v


def test_u32_and_half():
    choices = ((0, 0), (1, 4), (17, 8), (1, 22))
    for v in (0, 1, 16, 17, 272, 273, 1 << 20):
        w = entropy.BitWriter()
        entropy.write_u32(w, v, choices)
        assert entropy.read_u32(entropy.BitReader(w.bytes()), choices) == v
    assert entropy.half_to_float(0x3C00) == 1.0 and entropy.half_to_float(1) == 2.0**-24
    assert entropy.half_to_float(entropy.float_to_half(0.333)) == pytest.approx(0.333, abs=2e-4)


@settings(deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=300))
def test_symbol_codes(symbols):
    hist = np.bincount(symbols).tolist()
    counts = entropy.normalised(hist)
    assert sum(counts) == 4096 and all((c > 0) == (n > 0) for c, n in zip(counts, hist, strict=True))
    assert entropy.rans_decode(entropy.rans_encode(symbols, counts), len(symbols), counts) == symbols
    for most in (6, 15):
        lengths = entropy.limited_lengths(hist, most)
        assert max(lengths) <= most and sum(2.0**-n for n in lengths if n) <= 1
        assert entropy.prefix_decode(entropy.prefix_encode(symbols, lengths), len(symbols), lengths) == symbols


@given(st.lists(st.integers(0, 5), max_size=200))
def test_lz77_and_move_to_front(values):
    assert entropy.lz77_expand(entropy.lz77(values)) == values
    assert entropy.move_from_front(entropy.move_to_front(values, 6), 6) == values


def test_hand_worked_codes():
    assert entropy.prefix_codes([2, 1, 3, 3]) == [0b10, 0b0, 0b110, 0b111]
    assert entropy.lehmer_decode([2, 0, 1, 0]) == [2, 0, 3, 1]
    assert entropy.lz77([7, 7, 7, 7, 7, 7, 7, 7, 7]) == [(-1, 7), (8, 1)] or entropy.lz77_expand(entropy.lz77([7] * 9)) == [7] * 9
    with pytest.raises(ValueError):
        entropy.rans_decode(b"\x00\x00\x02\x00", 3, [4096])


def image(kind: int, h: int, w: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    made = [lambda: np.add.outer(np.arange(h), np.arange(w)) % 256, lambda: rng.integers(0, 256, (h, w)), lambda: np.full((h, w), 9), lambda: np.indices((h, w)).sum(0) % 2 * 65535, lambda: rng.integers(-300, 300, (h, w))]
    return made[kind]().astype(np.int64)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (3, 5), (17, 33)])
@pytest.mark.parametrize("kind", range(5))
def test_planes_round_trip(shape, kind):
    v = image(kind, *shape)
    assert (codec.decode_plane(codec.encode_plane(v)) == v).all()


def rows(spark, v: np.ndarray, img: int = 0):
    return spark.createDataFrame([(img, 0, y, r.tolist()) for y, r in enumerate(v)], "img long, c int, y long, row array<int>")


def test_codec_over_many_planes(spark):
    each = [image(k, 9, 11, k) for k in range(5)]
    df = rows(spark, each[0], 0)
    for k, v in enumerate(each[1:], 1):
        df = df.unionByName(rows(spark, v, k))
    back = codec.decode(codec.encode(df)).collect()
    assert {(r.img, r.y): list(r.row) for r in back} == {(k, y): v[y].tolist() for k, v in enumerate(each) for y in range(9)}


def test_causal_neighbours_at_edges(spark):
    v = image(1, 5, 6)
    got = {(r.y, r.x): r for r in planes.causal(rows(spark, v)).collect()}
    assert len(got) == 30
    for y in range(5):
        for x in range(6):
            r = got[y, x]
            left = v[y, x - 1] if x else v[y - 1, x] if y else 0
            top = v[y - 1, x] if y else left
            right = v[y - 1, x + 1] if y and x < 5 else top
            assert (r.left_, r.top_) == (left, top)
            assert r.topleft == (v[y - 1, x - 1] if x and y else left)
            assert r.topright == right
            assert r.leftleft == (v[y, x - 2] if x > 1 else left)
            assert r.toptop == (v[y - 2, x] if y > 1 else top)
            assert r.toprightright == (v[y - 1, x + 2] if y and x < 4 else right)


def test_predictors_are_all_there():
    assert sorted(predictors(PLAIN)) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13]


def tendency(b: int, a: int, n: int) -> int:
    """By search, for neighbours that rise or fall throughout: of the differences up to the rounded twelfth, the largest
    that keeps the pair between what comes before and after it, whose mean (rounded down) is a."""
    if not (b >= a >= n or b <= a <= n):
        return 0
    sign = 1 if b > n else -1
    rise, fall = abs(b - a), abs(a - n)
    wanted = round((4 * rise + 3 * fall) / 12 + 1e-9)
    fits = [d for d in range(wanted + 1) if d // 2 <= rise and d - d // 2 <= fall]
    return sign * max(fits) if b != a or n != a else 0


@pytest.mark.parametrize(("b", "a", "n", "want"), [(10, 10, 10, 0), (20, 10, 0, 6), (0, 10, 20, -6), (10, 10, 0, 1), (30, 10, 9, 2), (5, 9, 3, 0), (100, 0, -100, 58), (9, 8, 0, 2)])
def test_golden_tendencies(b, a, n, want):
    import duckdb

    assert tendency(b, a, n) == want
    assert duckdb.sql(f"select {smooth_tendency(PLAIN, f'({b})', f'({a})', f'({n})')}").fetchall()[0][0] == want


def test_tendencies_agree_with_the_search():
    import duckdb

    rng = random.Random(4)
    rows = [tuple(rng.randint(-40, 40) for _ in range(3)) for _ in range(2000)]
    values = ", ".join(f"({k}, {b}, {a}, {n})" for k, (b, a, n) in enumerate(rows))
    got = duckdb.sql(f"select {smooth_tendency(PLAIN, 'b', 'a', 'n')} from (values {values}) as t(k, b, a, n) order by k").fetchall()
    assert [r[0] for r in got] == [tendency(*r) for r in rows]


@pytest.mark.parametrize("shape", [(4, 7), (5, 6), (1, 1), (3, 2)])
def test_squeeze_can_be_undone(spark, shape):
    """Averages and residuals give the samples back, from left to right and from top to bottom."""
    v = image(1, *shape)
    df = rows(spark, v)
    for transposed, parts, line in ((False, lossless.squeeze_rows(df), "y"), (True, lossless.squeeze_columns(df), "x")):
        w = v.T if transposed else v
        got: dict = {}
        for r in parts.collect():
            got.setdefault(r[line], {})[r.k] = (r.avg, r.res)
        for y, pairs in got.items():
            out: list[int] = []
            for k in sorted(pairs):
                avg, res = pairs[k]
                if res is None:
                    out.append(avg)
                    continue
                diff = res + tendency(out[-1] if out else avg, avg, pairs[k + 1][0] if k + 1 in pairs else avg)
                a = avg + int(diff / 2)
                out += [a, a - diff]
            assert out == w[y].tolist()


def test_latest_patch_wins_and_uncovered_stays(spark):
    canvas = spark.range(16).selectExpr("0 as img", "id div 4 as y", "id % 4 as x", "0 as b")
    source = spark.range(16).selectExpr("0 as img", "id div 4 as sy", "id % 4 as sx", "cast(id as int) as f")
    patches = spark.createDataFrame([(0, 1, 0, 0, 2, 2, 0, 0), (0, 2, 2, 2, 2, 2, 1, 1)], "img int, n int, sx0 int, sy0 int, w int, h int, x int, y int")
    got = {(r.y, r.x): r.v for r in compose.blit(canvas, source, patches).collect()}
    assert got[0, 0] == 0 and got[0, 1] == 1 and got[1, 0] == 4 and got[1, 1] == 10 and got[2, 2] == 15 and got[3, 3] == 0


def test_boxes(spark):
    data = container.assemble(b"\xff\x0abody", [(b"Exif", b"\x00\x00\x00\x02zzTIFF"), (b"xml ", b"<x/>")])
    part = lambda no, body, last=False: container.box(b"jxlp", (no | (1 << 31 if last else 0)).to_bytes(4, "big") + body)
    split = container.SIGNATURE + container.box(*container.FTYP) + part(1, b"def", True) + part(0, b"abc")
    gap = container.SIGNATURE + part(0, b"abc") + part(2, b"def", True)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(split)), ("c", bytearray(gap)), ("d", bytearray(b"\x00\x00\x00\xffshort"))], "path string, content binary")
    boxes = container.boxes(df)
    assert boxes.where("path = 'a'").count() == 5 and boxes.where("path = 'd'").first().status == "box runs past the end"
    streams = {r.path: (r.codestream and bytes(r.codestream), r.status) for r in container.codestreams(boxes).collect()}
    assert streams["a"] == (b"\xff\x0abody", "ok") and streams["b"] == (b"abcdef", "ok") and streams["c"] == (None, "parts don't fit")
    assert bytes(container.exif(boxes).first().tiff) == b"TIFF" and container.xmp(boxes).first().xmp == "<x/>"
    assert [r.k for r in df.select(container.kind().alias("k")).collect()] == ["container", "container", "container", "unknown"]


def test_image_files(spark, tmp_path):
    netpbm.register(spark)
    made = {"a.pgm": (image(1, 3, 4)[:, :, None], 255), "b.ppm": (image(1, 2, 9).reshape(2, 3, 3) * 200, 65535), "c.pam": (image(1, 2, 8).reshape(2, 2, 4), 255), "d.pfm": (np.linspace(-1, 2, 12).reshape(2, 2, 3).astype(np.float32), 0)}
    for name, (samples, top) in made.items():
        (tmp_path / name).write_bytes(netpbm.dump(samples, top))
    got = spark.read.format("netpbm").load(str(tmp_path)).collect()
    for name, (samples, top) in made.items():
        mine = {(r.c, r.y): r for r in got if r.path.endswith(name)}
        for (c, y), r in mine.items():
            assert r.top == top and np.allclose(r.row, samples[y, :, c])
        assert len(mine) == samples.shape[0] * samples.shape[2]
    assert netpbm.parse(b"P5 # note\n1 1\n255\n\x07")[0].item() == 7
    assert netpbm.dump(np.array([[[300], [-5]]]), 255).endswith(b"\xff\x00")


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(3)
    frames = [(k % 3, k, rng.random() < 0.3, rng.randrange(4), rng.random() < 0.6, k >= 57) for k in range(60)]
    schema = "file long, n long, is_reference boolean, save_as int, presented boolean, is_last boolean"
    for part in range(3):
        spark.createDataFrame(frames[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = animation.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.file, r.n): tuple(r)[2:] for r in spark.table("frames").collect()}
    batch = compose.frame_counters(compose.reference_slots(spark.createDataFrame(frames, schema)))
    want = {(r.file, r.n): (r.ref_0, r.ref_1, r.ref_2, r.ref_3, r.visible, r.invisible) for r in batch.collect()}
    assert {k: v[4] for k, v in got.items()} == {k: v[4] for k, v in want.items()}
    assert got == want


def test_stencil_is_one_shuffle(spark):
    plan = planes.stencil(rows(spark, image(1, 4, 4)), 1, 1, (-1, 1)).where(F.col("x") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" not in plan
