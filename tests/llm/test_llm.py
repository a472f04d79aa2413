"""Operators against brute force, round trips and held-out accuracy, and the odd inputs of each."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, common, crf, licences, logbilinear, mih, packing, quality, sharding, simhash, toxicity, wordpieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near quiet water".split()
GERMAN = "der schnelle braune fuchs springt ueber den faulen hund und sieben kluge eulen sehen von einer alten eiche zu".split()
EXTRA = ["score", "shard", "piece", "row", "word", "block", "h", "fp", "kept", "label", "lang_pred"]


def prose(words: list[str], n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + ("" if rng.random() < 0.4 else rng.choice("abcdefghij") * rng.randint(1, 2)) for _ in range(n))


def corpus(n: int = 60) -> list[tuple]:
    rows = []
    for k in range(n):
        words, lang = (GERMAN, "de") if k % 3 == 0 else (ENGLISH, "en")
        text = prose(words, 60 + k, k)
        rows.append((k, text, lang, f"src{k % 2}", len(text)))
    return rows


ODD = [
    (1000, None, None, None, None),
    (1001, "", "en", "src0", 0),
    (1002, " \t\n\x0b ", "en", "src0", 5),
    (1003, "12 34 ## !!", None, "src1", 11),
    (1004, "x" * 70_000, "en", "src1", 70_000),
    (1005, "a " * 40_000, "en", None, 80_000),
    (1006, "Ärger ﬀ 漢字 é   \x00 <|endoftext|> 'S don't 4½", "de", "src0", 40),
    (None, "no id at all here", "en", "src0", 17),
    (3, "the same id as another row", "en", "src0", 26),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Prose, copies, odd texts, repeated rows, and columns whose names the operators use inside."""
    rows = corpus()
    copies = [(200 + k, rows[5][1], "en", "src0", 1) for k in range(12)]
    frame = spark.createDataFrame(rows + copies + ODD + ODD[:4], SCHEMA)
    return frame.withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> pd.DataFrame:
    return df.toPandas()


# -- 1 ---------------------------------------------------------------------------------------------------------


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(0)
    sizes, labels = np.array([1, 4, 130, 64, 65]), 3
    scores, moves = rng.standard_normal((sizes.sum(), labels)), rng.standard_normal((labels, labels))
    got, at = crf.posteriors(scores, sizes, moves), 0
    for n in sizes:
        s, step = scores[at : at + n], np.exp(moves)
        a, b, v = np.zeros((n, labels)), np.ones((n, labels)), np.full(labels, 1 / labels)
        for t in range(n):
            v = (v @ step) * np.exp(s[t])
            v /= v.sum()
            a[t] = v
        for t in range(n - 2, -1, -1):
            b[t] = step @ (np.exp(s[t + 1]) * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b / (a * b).sum(1, keepdims=True)
        assert np.allclose(got[at : at + n], want)
        at += n


def test_language_learns_and_covers_odd_inputs(docs, empty):
    found = collected(crf.languages(docs, per_language=40))
    assert len(found) == docs.count()
    plain = found[found.doc_id < 60].merge(pd.DataFrame([(r[0], r[2]) for r in corpus()], columns=["doc_id", "lang"]), on="doc_id")
    assert (plain.lang_pred == plain.lang).mean() > 0.95
    assert set(found[found.doc_id.isin([1000, 1001, 1002, 1003])].lang_pred) == {"und"}
    assert found.score.between(0, 1).all()
    assert collected(crf.languages(empty)).empty


def test_language_spans_of_switched_text(spark, docs):
    model = crf.train(docs.where("doc_id < 60"), 40)
    text = prose(ENGLISH, 30, 901) + " " + prose(GERMAN, 30, 902)
    one = crf.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, spans=True, keep=("doc_id",)).first()
    langs = [s["lang"] for s in one["spans"]]
    assert langs[0] == "en" and langs[-1] == "de"
    assert all(0 <= s["start"] < s["end"] <= len(text) for s in one["spans"])


def test_language_needs_letters(spark, docs):
    model = crf.train(docs.where("doc_id < 60"), 40)
    texts = ["½ ² ①", "Ⅷ ³ ٣", "İzmir İzmir hello world der hund", "x½y ok", "ﬀ ſ"]
    rows = {r.doc_id: r for r in crf.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, spans=True, keep=("doc_id",)).collect()}
    assert [rows[k].lang_pred == "und" for k in range(5)] == [True, True, False, False, False]
    assert rows[0].score == 0 and not rows[0].spans
    assert rows[2].spans[0]["start"] == 0 and rows[2].spans[-1]["end"] == len(texts[2])
    words = common.letter_words(texts[2])
    assert [w for w in words[2:]] == ["hello", "world", "der", "hund"] and len(words) == 6
    posterior = np.eye(len(model.labels))[[0, 0, 1, 1, 0, 0]]
    assert crf.runs_of(texts[2], model.labels, posterior) == [(0, 11, model.labels[0]), (12, 23, model.labels[1]), (24, 32, model.labels[0])]


def test_samples_are_bounded(spark):
    """Whatever shares an id or a text, and the same rows whatever the partitions."""
    rows = [(None, "a", f"t{k}") for k in range(300)] + [(7, "a", "same")] * 200 + [(k, "b", f"u{k}") for k in range(50)] + [(1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, label string, text string")
    got = [sorted(map(tuple, common.thinned(df.repartition(n), 20, ("doc_id", "text"))[0].collect()), key=repr) for n in (1, 7)]
    assert got[0] == got[1]
    assert Counter(r[1] for r in got[0])["a"] <= 20 and Counter(r[1] for r in got[0])["b"] == 20
    assert common.thinned(df, 20)[1] == {"a": 500, "b": 50}


# -- 2 ---------------------------------------------------------------------------------------------------------


def test_shared_backoff_is_normalised():
    ratios = toxicity.fit_ratios((Counter({"alpha": 5, "beta": 3, "alphabet": 2}), Counter({"scum": 4, "alpha": 2})))
    assert len(ratios.grams) == len(np.unique(ratios.grams))
    total, _ = ratios.of_words(["scum", "beta", "zzzz"])
    assert total[0] > 0 > total[1] and abs(total[2]) < total[0]  # only the first letter of zzzz has a known history


def slow_kneser_ney(by_class: tuple[Counter, Counter]):
    """P(letter | history) of each class, by the definitions, and the alphabet."""
    spelled = {w: ["<", *w, ">"] for w in by_class[0] + by_class[1]}
    alphabet = {c for codes in spelled.values() for c in codes}
    gram = lambda codes, i, k: (tuple(codes[max(0, i - k + 1) : i]), codes[i])

    def discount(counts: Counter, usual: float) -> float:
        ones, twos = (sum(n == m for n in counts.values()) for m in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else usual

    def level(counts: Counter, d: float, below):
        total, kinds = Counter(), Counter()
        for (h, _), n in counts.items():
            total[h] += n
            kinds[h] += 1

        def p(h, c, back):
            if not total[h]:
                return below(back, c)
            return max(counts[h, c] - d, 0) / total[h] + d * kinds[h] / total[h] * below(back, c)

        return p

    below = lambda h, c: 1 / max(2, len(alphabet))
    for k in range(1, toxicity.ORDER):
        follows = {(gram(codes, i, k), gram(codes, i, k + 1)) for codes in spelled.values() for i in range(1, len(codes))}
        counts = Counter(g for g, _ in follows)
        one = level(counts, discount(counts, 0.5), below)
        below = lambda h, c, one=one, k=k: one(h[max(0, len(h) - k + 1) :], c, h)
    out = []
    for words in by_class:
        counts = Counter()
        for w, n in words.items():
            for i in range(1, len(spelled[w])):
                counts[gram(spelled[w], i, toxicity.ORDER)] += n
        one = level(counts, discount(counts, 0.75), below)
        out.append(lambda h, c, one=one: one(h, c, h))
    return out, alphabet, spelled, gram


def test_kneser_ney_matches_its_definition():
    by_class = Counter({"alpha": 5, "beta": 3, "alphabet": 2, "bet": 1}), Counter({"scum": 4, "alpha": 2, "scumbag": 1, "betas": 1})
    p, alphabet, spelled, gram = slow_kneser_ney(by_class)
    for codes in spelled.values():
        for i in range(1, len(codes)):
            history = gram(codes, i, toxicity.ORDER)[0]
            for one in p:
                assert abs(sum(one(history, c) for c in alphabet) - 1) < 1e-9
    got, letters = toxicity.fit_ratios(by_class).of_words(list(spelled))
    for w, total, n in zip(spelled, got, letters, strict=True):
        grams = [gram(spelled[w], i, toxicity.ORDER) for i in range(1, len(spelled[w]))]
        assert n == len(grams) and abs(total - sum(math.log(p[1](*g)) - math.log(p[0](*g)) for g in grams)) < 1e-9


def test_toxicity_separates_and_covers_odd_inputs(spark, docs, empty):
    rows, marks = [], []
    for k in range(240):
        text = prose(ENGLISH, 80, k)
        if k % 4 == 0:
            words = text.split()
            for p in range(5, 80, 15):
                words[p] = random.Random(k + p).choice(["grimwald", "grimwalder", "grimwaldish", "snorkrat"])
            text = " ".join(words)
        rows.append((k, text))
        marks.append((k, int(k % 4 == 0)))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    train = spark.createDataFrame(rows, "doc_id long, text string")
    found = collected(toxicity.toxicity(train, labels)).merge(pd.DataFrame(marks, columns=["doc_id", "toxic"]), on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    odd = collected(toxicity.toxicity(docs, labels))
    assert len(odd) == docs.count() and odd.score.between(0, 1).all()
    none = labels.where("toxic = 9")
    assert set(collected(toxicity.toxicity(train, none)).score) == {0.0}
    assert collected(toxicity.toxicity(empty, labels)).empty


# -- 3 ---------------------------------------------------------------------------------------------------------


def brute_repeats(words: list[str]) -> int:
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    return len({k + o for k, w in enumerate(windows) if counts[w] > 1 for o in range(3)})


def test_quality_measures_match_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", " ", " ", "\n", "\t", "#", "é", "|", "\x0b", " "]) for _ in range(rng.randint(0, 60)))
        words = common.WORD.findall(text)
        lines = [x for x in text.split("\n") if common.WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines), len(lines) - len(set(lines)), brute_repeats(words))
        assert quality.measure(text) == want
    assert quality.measure(None) == (0, 0, 0, 0, 0, 0)


def test_quality_verdicts(docs, empty):
    found = collected(quality.quality_rules(docs))
    assert len(found) == docs.count()
    assert found[found.doc_id < 60].query("doc_id != 3").kept.all()
    assert not found[found.doc_id.isin([1000, 1001, 1002, 1004, 1005])].kept.any()
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == found.kept.sum()
    assert collected(quality.quality_rules(empty)).empty


def test_quality_thresholds_follow_the_group(spark):
    """The same symbol rate is usual in one source and an outlier in another."""
    noisy = lambda k, n: " ".join(w + ("|" if i % n == 0 else "") for i, w in enumerate(prose(ENGLISH, 100, k).split()))
    rows = [(k, noisy(k, 3), "en", "tables", 1) for k in range(50)] + [(100 + k, prose(ENGLISH, 100, k), "en", "prose", 1) for k in range(50)] + [(999, noisy(9, 3), "en", "prose", 1)]
    found = collected(quality.quality_rules(spark.createDataFrame(rows, SCHEMA), min_group=20)).set_index("doc_id")
    assert found.kept[:50].all() and not found.kept[999] and found.kept[100]


# -- 4 ---------------------------------------------------------------------------------------------------------


def test_pigeonhole_probing_is_exact():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    words[1::2] = words[::2] ^ (np.uint64(1) << rng.integers(0, 64, (150, 2)).astype(np.uint64))
    index = mih.Index(words)
    for radius in (0, 1, 5, 9, 40, 128):
        want = np.bitwise_count(words[:20, None, :] ^ words[None, :, :]).sum(2) <= radius
        assert (index.within(words[:20], radius) == want).all()


def slow_nearest(rows: list[tuple], k: int, asked) -> list[tuple]:
    once = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            once[i] = min(once.get(i, list(v)), list(v))
    out = []
    for q in filter(asked, sorted(once)):
        best = sorted((-mih.exact_product(once[q], v), i) for i, v in once.items() if i != q and len(v) == len(once[q]))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def test_nearest_of_repeated_ids_lengths_and_huge_numbers(spark):
    """In small tables every row is within reach, so results equal brute force."""
    rng = random.Random(7)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(40)]
    rows += rows[:20] + [(0, rows[0][1])] * 30 + [(k, rows[0][1]) for k in (101, 102, 103)] + [(5, [0.5] * 8)]
    rows += [(200 + k, [float(k + 1), 2.0]) for k in range(5)] + [(300, [1e200] + [0.0] * 7), (320, [-1e200, 1e200] + [1e200] * 6), (340, [1e-200] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"query_id": F.lit(1), "score": F.lit("clash")})
    got = [tuple(r) for r in mih.nearest(df, "vec_id % 20 = 0", k=20, bits=64, cover=1.0).orderBy("query_id", "rank").collect()]
    want = slow_nearest(rows, 20, lambda i: i % 20 == 0)
    assert {r[:1] for r in got} == {r[:1] for r in want}
    hits = len({r[:1] + r[2:] for r in got} & {r[:1] + r[2:] for r in want})
    assert len(got) == len(want) and hits >= 0.95 * len(want)
    zero = [r[2] for r in got if r[0] == 0]
    assert len(set(zero)) == 20 and 0 not in zero and {101, 102, 103} <= set(zero)
    assert [r[2] for r in got if r[0] == 200] == [204, 203, 202, 201]
    assert [r[3] for r in got if r[0] == 320 and r[2] == 300] in ([-math.inf], [])


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x[700:760] = x[700]  # exact copies
    rows = [(k, x[k].tolist()) for k in range(1500)]
    odd = [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [None] * 32), (None, [1.0] * 32), (5004, [1.0])]
    found = collected(mih.nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), "vec_id % 20 = 0", k=10, bits=128, sample=1000))
    assert set(found.query_id) == set(range(0, 1500, 20))
    exact = x.astype(float) @ x.astype(float).T
    hits = 0
    for q, g in found.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and q not in set(g.vec_id)
        order = np.lexsort((np.arange(1500), -exact[q]))
        hits += len(set(order[order != q][:10]) & set(g.vec_id))
        assert np.allclose(g.score, exact[q][g.vec_id])
    assert hits / 750 >= 0.9
    same = found[found.query_id == 720].sort_values("rank")
    assert list(same.vec_id) == list(range(700, 710))
    assert mih.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0
    few = mih.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>"), "vec_id = 0", k=10)
    assert few.count() == 3


# -- 5 ---------------------------------------------------------------------------------------------------------


def test_bpe_is_the_library_and_round_trips(docs, empty):
    enc = bpe.encoding(bpe.RANKS, bpe.public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    found = collected(bpe.round_trips(docs)).dropna(subset="doc_id")
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null and doc_id <> 3").collect()}
    for r in found[found.doc_id != 3].itertuples():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert collected(bpe.round_trips(empty)).empty


def test_bpe_cuts_are_safe():
    rng = random.Random(6)
    enc = bpe.encoding(bpe.RANKS, bpe.public_tokenizers.PATTERN)
    for _ in range(100):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "1", "é", " ", "!", "漢"]) for _ in range(300))
        parts = list(bpe.safe_parts(text, 7))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_of_long_runs_is_the_library():
    enc = bpe.encoding(bpe.RANKS, bpe.public_tokenizers.PATTERN)
    n = bpe.RUN + 5
    for text in (" " * n, "a" + "\n" * n, " " * n + "b", "a" + "\t" * n + "!" + " \u3000" * n, "\n" * n + " x " + " " * n + "'s", "x" * n + " " * (n - 6) + "1"):
        assert bpe.encode(text) == enc.encode_ordinary(text)


@pytest.mark.parametrize("run", [" ", "\n", " \t", "a", "!", "1"])
def test_bpe_of_a_million_characters_round_trips(spark, run):
    text = run * (1_500_000 // len(run)) + "end"
    row = bpe.round_trips(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_columns(spark):
    df = spark.createDataFrame([("héllo wörld",), (None,)], "text string").withColumn("ids", bpe.encoder()("text"))
    assert [bytes(r.raw).decode() for r in df.withColumn("raw", bpe.decoder()("ids")).collect()] == ["héllo wörld", ""]


# -- 6 ---------------------------------------------------------------------------------------------------------


def slow_fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps: list[int], radius: int = 2) -> list[int]:
    fp = np.array(fps, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = np.arange(len(fp))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return list(label)
        label = new


def test_fingerprints_match_brute_force():
    for _, text, *_ in corpus(20) + ODD:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("crowd", [2, 64])
def test_components_match_brute_force(spark, crowd):
    """Chains, balls around a centre that crowd keys, and strangers, with and without the way for crowded keys."""
    rng = np.random.default_rng(8)
    centre = int(rng.integers(0, 1 << 62))
    fps = [centre] + [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))]
    chain = int(rng.integers(0, 1 << 62))
    for k in range(0, 40, 2):
        chain ^= 3 << k
        fps.append(chain)
    fps += [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    fps = list(dict.fromkeys(x & ((1 << 64) - 1) for x in fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    printed = common.materialise(spark.createDataFrame([(k, f) for k, f in enumerate(signed)] + [(500, signed[3])], "doc_id long, fp long"), "test")
    got = {r.doc_id: r.component_id for r in simhash.classed(printed, "doc_id", crowd=crowd).collect()}
    want = closure(fps)
    assert all(got[k] == want[k] for k in range(len(fps)))
    assert got[500] == want[3]


def test_near_duplicates_odd_inputs(docs, empty):
    found = collected(simhash.near_duplicates(docs))
    assert len(found) == docs.count()
    assert set(found[found.doc_id.isin(range(200, 212))].component_id) == {5}
    assert found[found.doc_id.isin([1000, 1001, 1002])].fp.eq(0).all()
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    # One id has two texts here, so components are counted by fingerprints rather than by their ids.
    assert kept.count() == len(set(closure([int(x) & ((1 << 64) - 1) for x in found.fp])))
    assert collected(simhash.near_duplicates(empty)).empty and simhash.first_of_each(empty).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------------------


def fewest(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for j, b in enumerate(bins):
            if b + items[k] <= capacity and b not in seen:
                seen.add(b)
                bins[j] += items[k]
                go(k + 1, bins)
                bins[j] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_plans_are_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(max(1, capacity // 6), int(capacity * 0.7)) for _ in range(rng.randint(1, 10))]
        plan = packing.plan(Counter(items), capacity)
        used = Counter()
        for filling, times in plan:
            assert sum(s * c for s, c in filling) <= capacity
            for s, c in filling:
                used[s] += c * times
        assert used == Counter(items)
        assert sum(t for _, t in plan) == fewest(items, capacity)
    assert packing.plan({}) == [] and packing.lower_bound({}, 10) == 0


def test_completion_beats_best_fit_on_harder_sets():
    rng, better = random.Random(3), 0
    for _ in range(6):
        items = Counter(rng.randint(600, 2600) for _ in range(400))
        found = packing.plan(items, 4096)
        assert packing.excess(found, items, 4096) >= 0
        better += sum(n for _, n in found) < sum(n for _, n in packing.best_fit(items, 4096))
    assert better >= 5


def test_fillings_are_undominated():
    """No length in a filling can give way to a larger one that is left, and no length that is left still fits."""
    rng = random.Random(9)
    for _ in range(60):
        counts = Counter(rng.randint(5, 60) for _ in range(rng.randint(3, 25)))
        sizes = sorted(counts)
        for filling in packing.fillings(counts, sizes, 100, 64):
            used = dict(filling)
            room = 100 - sum(s * c for s, c in filling)
            assert room >= 0 and used[sizes[-1]] >= 1 and all(c <= counts[s] for s, c in filling)
            left = [s for s in sizes if counts[s] > used.get(s, 0)]
            assert not any(s <= room for s in left) and not any(0 < t - s <= room for s in used for t in left)


def test_word_ids_are_the_library():
    encoder = wordpieces.encoder()
    library = Tokenizer.from_file(public_tokenizers.path(wordpieces.VOCABULARY))
    texts = [r[1] for r in corpus(10) + ODD if r[0] != 1004]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "<|endoftext|>é <|endof text|>", "it's<|startoftext|>'s"]
    for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert list(ids) == library.encode(text or "", add_special_tokens=False).ids


def test_packing_covers_every_piece(docs, empty):
    capacity = 128
    found = collected(packing.pack(docs, capacity)).sort_values(["sequence_id", "offset"])
    encoder = wordpieces.encoder()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.append(encoder.encode(r.text), 1).astype("<u4")
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[(r.doc_id, n, start, len(part), zlib.crc32(part.tobytes()))] += 1
    got = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == want
    for _, g in found.groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= capacity
    assert collected(packing.pack(empty)).empty


# -- 8 ---------------------------------------------------------------------------------------------------------


def test_scores_match_brute_force_counts(docs, empty):
    found = collected(logbilinear.score(docs, block_tokens=3000))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    counts = Counter()
    for doc_id, text in rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update(logbilinear.tokens(text))
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows) and set(found.train_tokens) == {n}
    base = {}
    for doc_id, text in rows:
        words = logbilinear.tokens(text)
        base.setdefault(doc_id, set()).add((len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 5)))
    for r in found.itertuples():
        assert (r.n_tokens, r.n_known, round(r.base_score, 5)) in base[None if pd.isna(r.doc_id) else int(r.doc_id)]
    assert np.isfinite(found.score).all() and (found.score <= 0).all()
    assert collected(logbilinear.score(empty)).empty


def test_model_is_normalised_and_learns_context():
    rng = np.random.default_rng(9)
    # Even classes follow even ones, odd ones follow odd ones.
    y = [0]
    for _ in range(30_000):
        y.append(int(rng.integers(0, 4)) * 2 + y[-1] % 2 if rng.random() < 0.9 else int(rng.integers(0, 8)))
    y = np.array(y)
    before, before2 = np.concatenate([[8], y[:-1]]), np.concatenate([[8, 8], y[:-2]])
    frequencies = (np.bincount(y, minlength=8) + 1) / (len(y) + 8)
    model = logbilinear.Bilinear.start(frequencies)
    for k in range(4):
        model.learn(before, before2, y, frequencies, k)
    every = np.array([model.log_probabilities(np.full(1, 2), np.full(1, 4), np.full(1, w))[0] for w in range(8)])
    assert abs(np.exp(every).sum() - 1) < 1e-5
    assert model.log_probabilities(before, before2, y).mean() > np.log(frequencies)[y].mean() + 0.2
    again = logbilinear.Bilinear.from_rows(np.array(model.rows()))
    assert np.allclose(again.context, model.context) and np.allclose(again.bias, model.bias)


# -- 9 ---------------------------------------------------------------------------------------------------------


def test_licences_and_inheritance(spark, empty):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    files = spark.createDataFrame(
        [
            (1, "a/LICENSE", gpl),
            (2, "a/b/c/main", prose(ENGLISH, 50, 1)),
            (3, "a/b/other", prose(ENGLISH, 200, 2) + "\nReleased under the MIT License."),
            (4, "z/main", prose(ENGLISH, 50, 3)),
            (5, "ab/main", "not below a"),
            (6, None, "Licensed under the Apache License, Version 2.0."),
            (7, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."),
            (8, "a/empty", None),
            (9, "a/b/c/d", ""),
        ],
        "file_id long, path string, text string",
    ).withColumn("tokens", F.lit("clash"))
    got = {r.file_id: (r.licence, r.inherited, r.from_dir) for r in licences.scan(files).collect()}
    assert got[1] == ("GPL-3.0", False, None)
    assert got[2] == ("CC-BY-NC-4.0", True, "a/b")
    assert got[3] == ("MIT", False, None)
    assert got[4] == (None, False, None) and got[5] == (None, False, None)
    assert got[6][0] == "Apache-2.0"
    assert got[8] == ("GPL-3.0", True, "a") and got[9] == ("CC-BY-NC-4.0", True, "a/b")
    none = empty.select(F.col("doc_id").alias("file_id"), F.lit("p").alias("path"), "text")
    assert licences.scan(none).count() == 0


def slow_licences(files: list[tuple]) -> list[tuple]:
    """Own licence and cosine of every row, from all units and all tokens."""
    split = lambda t: {x for x in re.split("[^a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in t)) if x}
    units = [[(k, split(u)) for k, u in enumerate([text or "", *(text or "").split("\n")]) if split(u)] for _, _, text in files]
    df = Counter(t for row in units for _, tokens in row for t in tokens)
    n = sum(map(len, units))
    idf = lambda t: math.log((1 + n) / (1 + df[t]))
    norm = lambda tokens: math.sqrt(sum(idf(t) ** 2 for t in tokens))
    out = []
    for row in units:
        best = []
        for k, tokens in row:
            for name, licence, text in licences.TEMPLATES:
                wanted = split(text)
                cosine = round(sum(idf(t) ** 2 for t in tokens & wanted) / (norm(tokens) * norm(wanted)), 6)
                if cosine >= (licences.FILE if k == 0 else licences.LINE):
                    best.append((-cosine, name, licence))
        out.append((min(best)[2], -min(best)[0]) if best else (None, None))
    return out


def test_licences_match_brute_force(spark):
    """Repeated rows, two texts under one id, notices beside other words, and notices that many lines share."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        lines = [prose(ENGLISH, rng.randint(3, 12), k * 7 + j) for j in range(rng.randint(1, 4))]
        if k % 3 == 0:
            lines[rng.randrange(len(lines))] += " " + rng.choice(licences.TEMPLATES)[2]
        rows.append((k, f"d{k}/f", "\n".join(lines)))
    rows += [(70, "x/f", licences.TEMPLATES[1][2] + " in this file and all others of the tree")] * 4
    rows += [(71, "y/f", licences.TEMPLATES[8][2]), (71, "y/f", "nothing here at all"), (None, None, None), (72, None, "")]
    got = Counter((r.file_id, r.path, None if r.inherited else r.licence, r.cosine) for r in licences.scan(spark.createDataFrame(rows, "file_id long, path string, text string").repartition(4)).collect())
    want = slow_licences(rows)
    assert sum(x[0] is not None for x in want) > 15
    assert got == Counter((i, p, licence, c) for (i, p, _), (licence, c) in zip(rows, want, strict=True))


# -- 10 --------------------------------------------------------------------------------------------------------


def test_curve_is_a_hilbert_curve(spark):
    cells = collected(sharding.curve(spark)).sort_values("h")
    assert list(cells.h) == list(range(4096)) and set(cells.cell) == set(range(4096))
    xyz = np.array([(c >> 8, c >> 4 & 15, c & 15) for c in cells.cell])
    assert (np.abs(np.diff(xyz, axis=0)).sum(1) == 1).all()


def test_shards_are_even_and_gapless(docs, empty, tmp_path):
    found = collected(sharding.hilbert_shards(docs))
    sizes = found.groupby("shard").size()
    assert len(found) == docs.count() and sizes.max() - sizes.min() <= 1
    for _, g in found.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    order = found.sort_values(["shard", "slot"])
    assert (np.diff(order.h) >= 0).all()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.size, r.text_crc32) for r in found.itertuples()) == want
    assert collected(sharding.hilbert_shards(empty)).empty
    one = docs.where("doc_id < 60 and doc_id <> 3")
    placed = sharding.hilbert_shards(one)
    sharding.write_shards(one, placed, str(tmp_path / "shards"))
    assert one.sparkSession.read.parquet(str(tmp_path / "shards")).count() == one.count()
    assert sharding.bounds(placed).count() == 8


def slow_hilbert(point: tuple[int, ...], bits: int) -> int:
    """The place of a point on the curve: Gray code, with the turns of each step undone (Skilling's transpose form)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_curve_is_the_known_one(spark):
    assert all(r.h == slow_hilbert((r.cell >> 8, r.cell >> 4 & 15, r.cell & 15), 4) for r in sharding.curve(spark).collect())


def test_shards_prune_every_dimension_and_keep_copies_together(spark):
    rng = random.Random(5)
    rows = [(k, "w" * rng.randint(1, 4000), rng.choice(["de", "en", "es", "fr"]), f"src{rng.randrange(20):02d}", 1) for k in range(2000)]
    rows += [(5000 + k, "a text that many have", "fr", "src07", 1) for k in range(300)]
    rows += [(6000 + k, f"pair {k // 2}", "de", f"src{k // 10:02d}", 1) for k in range(200)]
    found = sharding.hilbert_shards(spark.createDataFrame(rows, SCHEMA)).toPandas()
    for column, value in (("lang", "en"), ("source", "src03"), ("size", 17)):
        ends = found.groupby("shard")[column].agg(["min", "max"])
        assert ((ends["min"] <= value) & (value <= ends["max"])).sum() <= 5, (column, ends)
    texts = {r[0]: r[1] for r in rows}
    found["text"] = found.doc_id.map(texts)
    spread = found.groupby("text").shard.nunique()
    named = spread[~spread.index.str.startswith("w")]
    assert (named > 1).sum() <= 7 and named["a text that many have"] <= 2


def test_ranks_keep_copies_together(spark):
    df = common.materialise(spark.range(600).selectExpr("id", "0 as g", "case when id < 300 then 7 else id % 90 end as same", "case when id < 300 then 300 + 3 else 3 end as copies"), "ranked")
    for bucket in (10, 50, 4000):
        got = collected(common.ranks(df, "g", ["same", "id"], 600, bucket, together="same", copies="copies")).sort_values("__rank")
        assert list(got["__rank"]) == list(range(600))
        if bucket == 4000:
            assert (got.same.diff() != 0).sum() == got.same.nunique()


def test_ranks_are_gapless_whatever_the_buckets(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g")
    for bucket in (1, 7, 4000):
        got = collected(common.ranks(df, "g", ["id"], 500, bucket))
        for _, g in got.groupby("g"):
            assert sorted(g["__rank"]) == list(range(len(g)))


# -- the pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_matches_its_stages_by_brute_force(spark, docs, empty, tmp_path):
    whole = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = whole
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = common.materialise(stage(spark, kept, ""), name)
        assert kept.columns == before.columns and kept.count() <= before.count()
        assert kept.count() == 0 or kept.subtract(before).count() == 0
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= {k for k in range(60) if k != 3} and not ids & {1000, 1001, 1002, 1003, 1004, 1005, *range(200, 212)}
    fps = [slow_fingerprint(r.text) for r in kept.collect()]
    assert closure(fps) == list(range(len(fps)))
    packed = collected(corpus_pipeline.STAGES[-1][1](spark, kept, ""))
    assert set(packed.doc_id.dropna().astype(int)) == {i for i in ids if i is not None}
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
