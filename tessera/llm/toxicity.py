"""Toxicity from class-conditional Kneser-Ney models.

The models spell words: a letter is predicted from up to ORDER - 1 letters before it in its word, so a rare
inflection or compound of a known expression is scored by the letters it shares with it. Each class has its own
discounted counts at the full order; below that both share one backoff, the Kneser-Ney continuation counts of
all training texts together. So where a class knows a history but not the letter, it pays its backoff weight,
and where neither class knows the history the letter says nothing: the shared backoff cancels.

A text has two kinds of evidence, both normalised by length: the log ratio P(toxic class) / P(ordinary class)
for each letter, and for each word, the part of its log ratio beyond MARGIN. The second leaves out the small
ratios that languages and topics have when they aren't spread alike over the classes, which add up in long
texts. A logistic curve, fitted on training texts that the counts have not seen, turns both into a score.

The models are fitted on a bounded sample of labelled rows (at most `per_class` of each class). Words are runs of
letters. Null and empty texts and texts without words have evidence 0 and get the score of that. Texts of any length
are scored whole. Repeated rows are scored alike and teach once; an id with both labels is toxic, null labels and null
ids teach nothing. Equal scores have no order. Without labels of both classes every score is 0; an empty table gives
an empty result. Columns besides those read never meet the operator's own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import Letters
from .common import documents_only, first_drawn, in_fold, letter_words, thinned

PER_CLASS, ORDER, CUT = 2000, 6, 0.3
#: In nats: a word that is this much likelier in toxic texts is an expression of its own.
MARGIN = 4.0
#: Letters scored at once; bounds a worker's memory.
AT_ONCE = 2_000_000


@dataclass
class Ratios:
    """What scoring needs of the two models: log ratios by history and letter, and by history alone."""

    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))
    histories: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    back: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: tuple[float, ...] = ()

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The summed log ratio and the number of letters of each word."""
        total, count = np.zeros(len(words)), np.zeros(len(words))
        if not len(self.grams):
            return total, count
        history, gram, word = Letters.of(words).histories(ORDER)
        value = np.zeros(len(gram))
        at = np.minimum(np.searchsorted(self.histories, history), len(self.histories) - 1)
        known = self.histories[at] == history
        value[known] = self.back[at[known]]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        seen = self.grams[at] == gram
        value[seen] = self.ratio[at[seen]]
        return np.bincount(word, value, len(words)), np.bincount(word, minlength=len(words)).astype(float)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, their summed weights, and the first place of each."""
    unique, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return unique, np.bincount(at, weights, len(unique)), first


def _shared_backoff(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """For every full-order gram of the pooled words, the Kneser-Ney probability of its letter one order below.

    Interpolated from the continuation counts (how many different letters a gram follows) of every lower order.
    """
    words = list(counts)
    letters = Letters.of(words)
    grams, first = np.unique(letters.histories(ORDER)[1], return_index=True)
    prob = np.full(len(grams), 1 / max(2, len(np.unique(letters.codes))))
    h, g, _ = letters.histories(1)
    for k in range(1, ORDER):
        longer_h, longer, _ = letters.histories(k + 1)
        # N1+(. g): different grams one letter longer that end in g.
        ones, at = np.unique(longer, return_index=True)
        low, cont, place = _summed(g[at], np.ones(len(at)))
        low_h = h[at][place]
        heads, inverse = np.unique(low_h, return_inverse=True)
        total, kinds = np.bincount(inverse, cont), np.bincount(inverse)
        n1, n2 = (cont == 1).sum(), (cont == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        mine = np.searchsorted(low, g[first])
        head = inverse[mine]
        prob = (cont[mine] - d) / total[head] + d * kinds[head] / total[head] * prob
        h, g = longer_h, longer
    return grams, prob


def _full_order(counts: Counter, grams: np.ndarray) -> np.ndarray:
    words = list(counts)
    _, g, word = Letters.of(words).histories(ORDER)
    mine, c, _ = _summed(g, np.fromiter(counts.values(), float, len(words))[word])
    full = np.zeros(len(grams))
    full[np.searchsorted(grams, mine)] = c
    return full


def _discounted(counts: np.ndarray, head: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(letter | history) interpolated with `below`, and the backoff weight of each history.

    A history without counts leaves all its mass to what lies below.
    """
    n1, n2 = (counts == 1).sum(), (counts == 2).sum()
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
    total, kinds = np.bincount(head, counts), np.bincount(head, counts > 0)
    back = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(counts - d, 0) / np.maximum(total[head], 1) + back[head] * below, back


def fit_ratios(by_class: tuple[Counter, Counter]) -> Ratios:
    """by_class: how often each word occurs in ordinary and in toxic texts."""
    grams, shared = _shared_backoff(by_class[0] + by_class[1])
    log_p, log_back = [], []
    history, gram, _ = Letters.of(list(by_class[0] + by_class[1])).histories(ORDER)
    heads, inverse = np.unique(history[np.unique(gram, return_index=True)[1]], return_inverse=True)
    for counts in by_class:
        p, back = _discounted(_full_order(counts, grams), inverse, shared)
        log_p.append(np.log(p))
        log_back.append(np.log(np.maximum(back, 1e-9)))
    return Ratios(grams, log_p[1] - log_p[0], heads, log_back[1] - log_back[0])


def evidence(ratios: Ratios, texts: list[list[str]]) -> np.ndarray:
    """Rows of (log ratio for each letter, what words have beyond MARGIN for each word)."""
    index: dict[str, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for words in texts for w in words), np.int64)
    total, count = ratios.of_words(list(index))
    sizes = np.array([len(x) for x in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    s, n, beyond = (np.bincount(doc, v[at], len(texts)) for v in (total, count, np.maximum(total - MARGIN, 0)))
    return np.column_stack([s / np.maximum(n, 1), beyond / np.maximum(sizes, 1)])


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0], np.log(1e-3 + x[:, 1])])


def _logistic(design: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method with a small penalty, so that separable samples have an end."""
    scale = np.maximum(np.abs(design).max(0), 1e-9)
    z, w = design / scale, np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def _counted(words: list[list[str]], y: np.ndarray, take: np.ndarray) -> tuple[Counter, Counter]:
    """How often each word occurs in the ordinary and in the toxic texts among those to take."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for k in np.flatnonzero(take):
        counts[int(y[k])].update(words[k])
    return counts


def _both(words: list[list[str]], y: np.ndarray, take: np.ndarray) -> bool:
    return all(any(words[k] for k in np.flatnonzero(take & (y == label))) for label in (0, 1))


def fit(sample: pd.DataFrame, odds: float | None = None) -> Ratios:
    """sample: label (0 or 1) and text. The counts come from all texts; the curve is fitted on the evidence that each
    third of the texts has from counts of the other two.

    odds: of a toxic text among all labelled ones, where the sample is thinned by class.
    """
    sample = sample.drop_duplicates(["label", "text"])
    texts = sample["text"].to_list()
    y = sample["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Ratios()
    turn = np.zeros(len(y), int)
    for label in (0, 1):
        turn[y == label] = np.arange((y == label).sum()) % 3
    words = [letter_words(text) for text in texts]
    parts, order = [], []
    for held in range(3):
        ratios = fit_ratios(_counted(words, y, turn != held)) if _both(words, y, turn != held) else Ratios()
        at = np.flatnonzero(turn == held)
        parts += [evidence(ratios, [words[k] for k in at[i : i + 100]]) for i in range(0, len(at), 100)]
        order.append(at)
    if not _both(words, y, turn >= 0):
        return Ratios()
    ratios = fit_ratios(_counted(words, y, turn >= 0))
    seen = np.concatenate(order)
    curve = _logistic(_design(np.concatenate(parts)), y[seen])
    if odds:
        curve[0] += np.log(odds) - np.log(y.sum() / (1 - y).sum())
    ratios.curve = tuple(curve)
    return ratios


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ratios:
    """labels: doc_id and toxic (0 or 1; other values and nulls are left out; an id with both is toxic).

    The labels are thinned before they meet the texts, so the join broadcasts about 2 * per_class ids and no text
    is shuffled.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    drawn, n = thinned(marked.agg(F.max("toxic").cast("string").alias("label")), per_class)
    drawn = drawn.select(F.col("doc_id").alias("__id"), "label")
    rows = documents_only(docs).join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))
    # An id may have many texts; the sample stays at per_class of each class.
    few = first_drawn(rows.withColumn("__draw", F.xxhash64("doc_id", "text")), "__draw", per_class)
    sample = few.select("label", "text").toPandas().sort_values(["label", "text"], ignore_index=True)
    odds = n["1"] / n["0"] if n.get("0") and n.get("1") else None
    return fit(sample.assign(label=sample["label"].astype(int)), odds)


def score(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """doc_id, log_ratio (for each letter), beyond (for each word) and score of every whole text."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, start, n = [], 0, 0
            for k, text in enumerate(batch["text"]):
                texts.append(letter_words(text))
                n += sum(map(len, texts[-1]))
                if n > AT_ONCE or k == len(batch) - 1:
                    x = evidence(ratios, texts)
                    p = 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(ratios.curve), -30, 30))) if ratios.curve else np.zeros(len(x))
                    ids = batch["doc_id"].iloc[start : k + 1].astype("Int64")
                    yield pd.DataFrame({"doc_id": ids.array, "log_ratio": x[:, 0], "beyond": x[:, 1], "score": p})
                    texts, start, n = [], k + 1, 0

    return documents_only(docs).mapInPandas(scored, "doc_id long, log_ratio double, beyond double, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, per_class: int = PER_CLASS) -> DataFrame:
    """score() with held_out and predicted; the labels of the fold `held` teach nothing."""
    taught = ~in_fold(F.col("doc_id"), folds, held)
    scored = score(docs, train(docs.where(taught), labels.where(taught), per_class))
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "log_ratio", "beyond")
