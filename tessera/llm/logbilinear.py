"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, over whole-corpus counts.

Tokens are words with A-Z lower-cased, then one end for each text. The corpus is read once, into blocks of
about BLOCK_TOKENS tokens: the texts as numbers of the block's own word list, and that list with the number of
times each word occurs in the block's training texts. Counting a word over the corpus is then a sum over the
blocks that list it, one shuffle of word lists instead of one of (text, word) pairs, and a frequent word is no
heavier than any other: it has one row for each block.

The model predicts classes: the most frequent words each alone, all others by a hash of their last bytes. The
class of the next token is scored by r . q + b, with r the sum of the vectors of the two tokens before, each
weighted by its position. Each block trains a copy on all of its training texts, with noise drawn from the
class frequencies of the whole corpus, and the copies are averaged by their tokens. Within a class of several
words, a word has the probability (c + 1) / (N_k + V_k + 1) from the counts of the whole corpus, which leaves
1 / (N_k + V_k + 1) to words that training has not seen. So the score is a normalised log probability.

Blocks are runs of a task's rows, and copies of the model are averaged, so scores (not counts or base scores) change
somewhat with how the table is partitioned. FREQUENT, TAILS and WIDTH bound the neural part whatever the data.

Null and empty texts are the end alone. A null doc_id is a training text. Texts of any length are taken whole; a block
is as long as the text that ends it. Repeated rows each count and are each scored, alike if they share a block. Words of
equal count get their classes in order of their bytes. Columns besides doc_id and text never meet the operator's own.
Without training texts every word has the one share that is left to unseen words; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_only, in_fold, materialise, text_of

BLOCK_TOKENS = 1_500_000
#: A word's spot is its block's number and then its own in that many bits.
SPOT_BITS = 28
FREQUENT, TAILS, TAIL_BYTES = 384, 128, 3
WIDTH, NOISE, BATCH, RATE, START = 24, 64, 1024, 0.1, 1e-6
#: The word that stands for the end of a text; no word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    words = text_of(text).encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def blocks(docs: DataFrame, folds: int, held: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of two kinds. A block has its texts: doc_ids, held_out, sizes, and all tokens as compressed numbers of
    its word list. A word of a block has its spot (block and number), the word, and c, its count in training texts."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = TaskContext.get().partitionId() << 16
        index: dict[bytes, int] = {}
        texts: list[tuple] = []
        n = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal made, n
            doc_ids, held_out, seqs = zip(*texts, strict=True)
            counted = [s for s, out in zip(seqs, held_out, strict=True) if not out]
            c = np.bincount(np.concatenate([*counted, np.zeros(0, np.uint32)]).astype(np.int64), minlength=len(index))
            row = {
                "block": made,
                "doc_ids": [None if pd.isna(x) else int(x) for x in doc_ids],
                "held_out": list(map(bool, held_out)),
                "sizes": list(map(len, seqs)),
                "ids": _packed(np.concatenate(seqs)),
                "spot": None,
                "word": None,
                "c": None,
            }
            yield pd.DataFrame([row]).astype({"spot": "Int64", "c": "Int64"})
            words = list(index)
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                spots = (made << SPOT_BITS) + np.arange(k, k + len(part))
                empty = dict.fromkeys(("doc_ids", "held_out", "sizes", "ids"), pd.Series([None] * len(part), dtype=object))
                yield pd.DataFrame({"block": made, **empty, "spot": spots, "word": pd.Series(part, dtype=object), "c": c[k : k + len(part)]}, columns=list(row))
            index.clear(), texts.clear()
            made, n = made + 1, 0

        for batch in batches:
            for doc_id, held_out, text in zip(batch["doc_id"].astype("Int64"), batch["held_out"], batch["text"], strict=True):
                words = tokens(text)
                ids = np.fromiter([index.setdefault(w, len(index)) for w in words], np.uint32, len(words))
                texts.append((doc_id, held_out, ids))
                n += len(ids)
                if n >= block_tokens:
                    yield from flush()
        if texts:
            yield from flush()

    schema = "block long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, ids binary, spot long, word binary, c long"
    return documents_only(docs, in_fold(F.col("doc_id"), folds, held).alias("held_out")).mapInPandas(split, schema)


def _packed(x: np.ndarray) -> bytes:
    """Numbers with their bytes by place, which compresses well."""
    x = np.ascontiguousarray(x)
    return zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


@dataclass
class Counts:
    """Of the training tokens: all, different ones, and tokens and different words of each class."""

    n: int
    v: int
    class_n: np.ndarray
    class_v: np.ndarray
    frequent: int

    @property
    def within(self) -> np.ndarray:
        """Log10 of the denominator of a word in its class; 0 for classes of one word."""
        many = np.log10(self.class_n + self.class_v + 1.0)
        many[: self.frequent] = 0
        return many


@dataclass
class Bilinear:
    context: np.ndarray  # (classes + 1, width): vectors before; the last stands before a text
    target: np.ndarray  # (classes, width)
    bias: np.ndarray
    position: np.ndarray  # (2, width)

    @classmethod
    def start(cls, frequencies: np.ndarray, width: int = WIDTH, seed: int = 11) -> Bilinear:
        rng = np.random.default_rng(seed)
        n = len(frequencies)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(draw(n + 1, width), draw(n, width), np.log(frequencies).astype(np.float32), np.ones((2, width), np.float32))

    def predicted(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        return self.context[before] * self.position[0] + self.context[before2] * self.position[1]

    def learn(self, before: np.ndarray, before2: np.ndarray, target: np.ndarray, frequencies: np.ndarray, seed: int) -> None:
        """One pass of noise-contrastive estimation; a batch shares its noise words, so it is three matrix products."""
        rng = np.random.default_rng(seed)
        log_noise = (np.log(frequencies) + np.log(NOISE)).astype(np.float32)
        parts = (self.context, self.target, self.bias, self.position)
        sums = [np.full(p.shape, START, np.float32) for p in parts]
        order = rng.permutation(len(target))
        upto = np.cumsum(frequencies)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            b1, b2, y = before[rows], before2[rows], target[rows]
            noise = np.minimum(np.searchsorted(upto, rng.random(NOISE) * upto[-1], side="right"), len(frequencies) - 1)
            c1, c2 = self.context[b1], self.context[b2]
            r = c1 * self.position[0] + c2 * self.position[1]
            q = self.target[y]
            real = _sigmoid((r * q).sum(1) + self.bias[y] - log_noise[y]) - 1
            fake = _sigmoid(r @ self.target[noise].T + self.bias[noise] - log_noise[noise])
            g_r = real[:, None] * q + fake @ self.target[noise]
            grads = [np.zeros_like(p) for p in parts]
            _add_rows(grads[0], b1, g_r * self.position[0])
            _add_rows(grads[0], b2, g_r * self.position[1])
            _add_rows(grads[1], y, real[:, None] * r)
            _add_rows(grads[1], noise, fake.T @ r)
            grads[2] += np.bincount(y, real, len(grads[2])) + np.bincount(noise, fake.sum(0), len(grads[2]))
            grads[3][0], grads[3][1] = (g_r * c1).sum(0), (g_r * c2).sum(0)
            for p, g, s in zip(parts, grads, sums, strict=True):
                g /= len(rows)
                s += g * g
                p -= RATE * g / np.sqrt(s)

    def log_probabilities(self, before: np.ndarray, before2: np.ndarray, target: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """Natural log probabilities of the targets. Each different pair of tokens before is normalised once."""
        pairs, at = np.unique(before.astype(np.int64) * len(self.context) + before2, return_inverse=True)
        r = self.predicted(pairs // len(self.context), pairs % len(self.context))
        total = np.empty(len(pairs), np.float32)
        for k in range(0, len(pairs), at_once):
            s = r[k : k + at_once] @ self.target.T + self.bias
            most = s.max(1)
            total[k : k + at_once] = most + np.log(np.exp(s - most[:, None]).sum(1))
        out = np.empty(len(target))
        for k in range(0, len(target), 1 << 16):
            a, y = at[k : k + (1 << 16)], target[k : k + (1 << 16)]
            out[k : k + (1 << 16)] = np.einsum("ij,ij->i", r[a], self.target[y]) + self.bias[y] - total[a]
        return out

    def rows(self) -> list[np.ndarray]:
        """The parameters as rows of equal width, for summing in Spark."""
        targets = np.column_stack([self.target, self.bias])
        wide = lambda x: np.column_stack([x, np.zeros(len(x), np.float32)])
        return [*wide(self.context), *targets, *wide(self.position)]

    @classmethod
    def from_rows(cls, rows: np.ndarray) -> Bilinear:
        n = (len(rows) - 3) // 2
        rows = rows.astype(np.float32)
        return cls(rows[: n + 1, :-1].copy(), rows[n + 1 : 2 * n + 1, :-1].copy(), rows[n + 1 : 2 * n + 1, -1].copy(), rows[2 * n + 1 :, :-1].copy())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.maximum(x, -30)))


def _add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """into[at] += rows, where `at` may repeat."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    into[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def _sequences(row, classes: int, train_only: bool) -> tuple[np.ndarray, ...]:
    """Of all tokens of a coded block: local number, class, and the classes one and two tokens before; and the texts' sizes."""
    local, cls = _unpacked(row.ids, "<u4").astype(np.int64), _unpacked(row.cls, "<u2").astype(np.int64)
    sizes = np.asarray(row.sizes, np.int64)
    if train_only:
        kept = ~np.asarray(row.held_out, bool)
        local, sizes = local[np.repeat(kept, sizes)], sizes[kept]
    starts = np.cumsum(sizes) - sizes
    y = cls[local]
    before = np.concatenate([[classes], y[:-1]])
    before[starts] = classes
    before2 = np.concatenate([[classes], before[:-1]])
    before2[starts] = classes
    return local, y, before, before2, sizes


def frequent_words(split: DataFrame, frequent: int) -> list[bytes]:
    """The words that get a class each: those of the training texts with the highest counts over all blocks."""
    summed = split.where("word is not null and c > 0").groupBy("word").agg(F.sum("c").alias("c"))
    return [bytes(r["word"]) for r in summed.orderBy(F.desc("c"), "word").limit(frequent).collect()]


def coded(split: DataFrame, frequent: int = FREQUENT) -> tuple[DataFrame, Counts]:
    """The blocks with the class of each of their words and its count over the corpus, and the corpus counts.

    Words are summed over the blocks in one shuffle, and go back to their blocks in another, where they meet the
    texts. Training and scoring then read blocks without shuffling anything.
    """
    top = frequent_words(split, frequent)
    ranked = split.sparkSession.createDataFrame([(w, k) for k, w in enumerate(top)], "word binary, rank int")
    classes = len(top) + TAILS
    word = Window.partitionBy("word")
    owner = F.row_number().over(word.orderBy("spot")) == 1
    listed = split.where("word is not null").select("spot", "word", "c")
    tail = F.crc32(F.expr(f"substring(word, greatest(length(word) - {TAIL_BYTES - 1}, 1), {TAIL_BYTES})")) % TAILS
    summed = listed.select("spot", "word", F.sum("c").over(word).alias("c"), owner.alias("first"))
    summed = summed.join(F.broadcast(ranked), "word", "left")  # at most `frequent` words
    words = summed.select(F.shiftright("spot", SPOT_BITS).alias("block"), "spot", "c", F.coalesce("rank", tail + len(top)).cast("int").alias("cls"), "first")

    def code(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, n = left.iloc[0], len(right)
        at = right["spot"].to_numpy(np.int64) & ((1 << SPOT_BITS) - 1)
        c, cls = np.zeros(n, np.int64), np.zeros(n, np.int64)
        c[at], cls[at] = right["c"].to_numpy(np.int64), right["cls"].to_numpy(np.int64)
        own = right["first"].to_numpy(bool) & (right["c"].to_numpy(np.int64) > 0)
        mine, of = right["c"].to_numpy(np.int64)[own], right["cls"].to_numpy(np.int64)[own]
        class_n = np.zeros(classes, np.int64)
        np.add.at(class_n, of, mine)
        out = {k: row[k] for k in ("block", "doc_ids", "held_out", "sizes", "ids")}
        return pd.DataFrame([out | {"counts": _packed(c), "cls": _packed(cls.astype("<u2")), "class_n": class_n, "class_v": np.bincount(of, minlength=classes)}])

    schema = "block long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, ids binary, counts binary, cls binary, class_n array<long>, class_v array<long>"
    texts = split.where("ids is not null").select("block", "doc_ids", "held_out", "sizes", "ids")
    out = materialise(texts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(code, schema), "coded")
    each = out.select(F.posexplode(F.arrays_zip("class_n", "class_v")).alias("k", "x"))
    class_n, class_v = np.zeros(classes), np.zeros(classes)
    for r in each.groupBy("k").agg(F.sum("x.class_n").alias("n"), F.sum("x.class_v").alias("v")).collect():  # one row for each class
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    return out, Counts(int(class_n.sum()), int(class_v.sum()), class_n, class_v, len(top))


def train(blocks_: DataFrame, counts: Counts) -> Bilinear:
    """The average, weighted by tokens, of a model for each block."""
    frequencies = (counts.class_n + 1) / (counts.class_n + 1).sum()
    classes = len(frequencies)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                _, y, before, before2, _ = _sequences(row, classes, True)
                if len(y):
                    model = Bilinear.start(frequencies)
                    model.learn(before, before2, y, frequencies, seed=int(row.block))
                    rows = model.rows()
                    yield pd.DataFrame({"row": range(len(rows)), "weight": float(len(y)), "v": [x.astype(float) for x in rows]})

    learnt = blocks_.select("block", "held_out", "sizes", "ids", "cls").mapInPandas(fit, "row int, weight double, v array<double>")
    mean = [(F.sum(F.col("weight") * F.col("v")[j]) / F.sum("weight")).alias(f"v{j}") for j in range(WIDTH + 1)]
    averaged = learnt.groupBy("row").agg(*mean).toPandas().sort_values("row")  # 2 * classes + 3 rows
    return Bilinear.from_rows(averaged.drop(columns="row").to_numpy()) if len(averaged) else Bilinear.start(frequencies)


def score(docs: DataFrame, folds: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    blocks_, counts = coded(materialise(blocks(docs, folds, held, block_tokens), "blocks"))
    model = train(blocks_, counts)
    classes, within = len(counts.class_n), counts.within
    all_base = np.log10(counts.n + counts.v + 1)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                local, y, before, before2, sizes = _sequences(row, classes, False)
                c = _unpacked(row.counts, np.int64)
                log_c = np.log10(c + 1.0)[local]
                model_score = model.log_probabilities(before, before2, y) / np.log(10)
                model_score += np.where(y >= counts.frequent, log_c - within[y], 0)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                total = lambda v, doc=doc, n=len(sizes): np.bincount(doc, v, n)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([None if x is None or x != x else int(x) for x in row.doc_ids], "Int64"),
                        "held_out": np.asarray(row.held_out, bool),
                        "n_tokens": sizes,
                        "n_known": np.rint(total((c > 0)[local].astype(float))).astype("int64"),
                        "train_tokens": counts.n,
                        "base_score": total(log_c) - sizes * all_base,
                        "score": total(model_score),
                    }
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks_.drop("class_n", "class_v").mapInPandas(scored, schema)
