"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts the subsequences of three characters that they share, gaps allowed, each weighted by
DECAY to the power of its span in either word, so a word with inserted or dropped characters stays close to the word it
came from. Words carry marks at both ends. Nystroem features span the kernel by a set of landmark words; as the kernel
is an inner product, the machine's score of any word collapses into one table of subsequence weights.

A text is as toxic as its worst word. Sentences come with the label of their text only, so words whose texts are toxic far
more often than chance (a binomial tail) stand for the positive class, words of clean texts for the negative one, and
negatives that score high are added in rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held, held_out, map_batches, parts

#: Labelled rows of either class that the model is fitted on at most (those of lowest hash).
TOXIC_ROWS, CLEAN_ROWS = 1_500, 3_500
#: Characters of one of them that reach the driver at most.
ROW_CHARS = 100_000
DECAY, SPAN, CODES = 0.6, 6, 64
LANDMARKS, ROUNDS, PER_ROUND = 160, 3, 3_000
COST = 20.0
#: A word stands for the positive class if chance explains its share of toxic texts with less than this probability.
BY_CHANCE = 1e-5
KNOWN = 700_000
THRESHOLD = 0.7
#: Letters that stand alone, three or more in a row: a word with blanks put in.
SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
_BETWEEN = re.compile(r"[\W\d_]+")
_TRIPLES = [(a, b, DECAY ** (a + b + 1)) for a in range(1, SPAN) for b in range(1, SPAN - a)]


def _code_table() -> np.ndarray:
    """Codes of characters: marks and ASCII letters have their own, all others share the rest."""
    table = 32 + np.arange(0x10000) % (CODES - 32)
    table[ord("^")], table[ord("$")] = 0, 1
    for k in range(26):
        table[97 + k] = 2 + k
    return table.astype(np.int64)


_CODES = _code_table()


def forms(word: str) -> list[str]:
    """What of a lower-case word is scored: its letters joined, and, if signs or digits stand between, each run of letters."""
    runs = [x for x in _BETWEEN.split(word) if x]
    if not runs:
        return []
    return runs if len(runs) == 1 else ["".join(runs), *(x for x in runs if len(x) > 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every subsequence of three characters within SPAN, and each word's norm: the root of the
    sum of squared weights, by which the kernel is divided."""
    marked = [f"^{w}$" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _CODES[np.minimum(points, 0xFFFF)]
    word = np.repeat(np.arange(len(words)), size)
    at, code, weight = [], [], []
    for a, b, w in _TRIPLES:
        n = len(c) - a - b
        if n <= 0:
            continue
        same = word[:n] == word[a + b:]
        at.append(word[:n][same])
        code.append((c[:n] * CODES * CODES + c[a:a + n] * CODES + c[a + b:])[same])
        weight.append(np.full(int(same.sum()), w, np.float32))
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.ones(len(words))
    at, code, weight = map(np.concatenate, (at, code, weight))
    norm = np.sqrt(np.bincount(at, weight.astype(np.float64) ** 2, len(words)))
    return at, code, weight, np.maximum(norm, 1e-9)


@dataclass
class Model:
    """weights: by subsequence code; bias; slope and level: from a text's largest word score to its log odds."""

    weights: np.ndarray
    bias: float
    slope: float
    level: float

    def words(self, words: list[str]) -> np.ndarray:
        at, code, weight, norm = subsequences(words)
        return np.bincount(at, weight * self.weights[code], len(words)) / norm + self.bias

    def probability(self, largest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * largest + self.level, -30, 30)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def largest(self, texts: list[str]) -> np.ndarray:
        """Of each text, the largest score of a word; the bias if it has none."""
        split = []
        for t in texts:
            t = t.lower()
            words = t.split()
            if SPACED.search(t):
                words += [re.sub(r"\s", "", m[0]) for m in SPACED.finditer(t)]
            split.append(words)
        new = set().union(*split) - self.known.keys()
        if new:
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = set().union(*split)
            self._learn(sorted(new))
        known, bias = self.known, self.model.bias
        return np.array([max(map(known.__getitem__, words), default=bias) for words in split], np.float64)

    def _learn(self, words: list[str], step: int = 20_000) -> None:
        for a in range(0, len(words), step):
            some = words[a:a + step]
            owner, each = [], []
            for k, w in enumerate(some):
                for f in forms(w):
                    owner.append(k)
                    each.append(f)
            best = np.full(len(some), self.model.bias)
            if each:
                np.maximum.at(best, owner, self.model.words(each))
            self.known.update(zip(some, best.tolist(), strict=True))


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss, by Newton steps in the primal."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    before = None
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        if before is not None and np.array_equal(inside, before):
            break
        s, c = x[inside], cost[inside]
        w = np.linalg.solve(ridge + (s * c[:, None]).T @ s, (s * c[:, None]).T @ y[inside])
        before = inside
    return w


def _cover(where: dict[str, list[int]], least: int = 2, times: int = 3) -> list[str]:
    """Words that explain the toxic texts, each the word of most texts that fewer than ``times`` words before it explain.
    Words of a toxic text that is there in many near copies explain nothing once its insults do."""
    left = Counter({w: len(x) for w, x in where.items()})
    words_of: dict[int, list[str]] = {}
    for w, x in where.items():
        for n in x:
            words_of.setdefault(n, []).append(w)
    out, explained = [], Counter()
    while left:
        w, n = max(left.items(), key=lambda x: (x[1], len(where[x[0]]), x[0]))
        if n < least:
            break
        out.append(w)
        left.pop(w)
        for text in where[w]:
            explained[text] += 1
            if explained[text] == times:
                left.subtract(x for x in words_of[text] if x in left)
        left = +left
    return out


def _apart(texts: list[tuple[set[str], int]]) -> list[tuple[set[str], int]]:
    """The texts (words, label) without near copies: of those that share half of their eight least word hashes, the first."""
    out, seen = [], {}
    for k, (own, y) in enumerate(texts):
        least = sorted(zlib.crc32(w.encode()) for w in own)[:8]
        common = Counter(n for h in least for n in seen.get(h, ()))
        if common and max(common.values()) >= 4:
            continue
        for h in least:
            seen.setdefault(h, []).append(k)
        out.append((own, y))
    return out


def _log_tail(k: int, n: int, p: float) -> float:
    """A bound on the log of the chance of k or more of n at rate p (Chernoff)."""
    r = k / n
    if r <= p:
        return 0.0
    return -n * (r * np.log(r / p) + ((1 - r) * np.log((1 - r) / (1 - p)) if r < 1 else 0.0))


def fit(rows: list[tuple[str, int]]) -> Model:
    """The model of labelled texts (text, 1 toxic or 0). Without both classes, or with no word that stands for toxicity,
    every text scores the share of toxic rows (one half if there are no rows)."""
    toxic = sum(y for _, y in rows)
    share = (toxic + 1) / (len(rows) + 2)
    nothing = Model(np.zeros(CODES ** 3, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    if not 0 < toxic < len(rows):
        return nothing
    with_, all_, where = Counter(), Counter(), {}
    for n, (own, y) in enumerate(_apart([({f for w in set(t.lower().split()) for f in forms(w)}, y) for t, y in sorted(set(rows))])):
        all_.update(own)
        if y:
            with_.update(own)
            for f in own:
                where.setdefault(f, []).append(n)
    rate = toxic / len(rows)
    candidates = sorted((w for w, k in with_.items() if k >= 3 and k > 0.9 * all_[w] and _log_tail(k, all_[w], rate) < np.log(BY_CHANCE)), key=lambda w: (-with_[w], w))
    positive = _cover({w: where[w] for w in candidates})
    if not positive:
        return nothing
    taken = set(candidates)
    clean = [w for w in sorted(all_, key=lambda w: (-all_[w], w)) if all_[w] > with_[w] and w not in taken]
    rng = np.random.default_rng(7)
    negative = clean[:PER_ROUND] + [clean[k] for k in rng.permutation(len(clean))[:PER_ROUND]]
    half = LANDMARKS // 2
    landmarks = list(dict.fromkeys([*positive[:half], *(negative[k] for k in rng.permutation(len(negative))[:half])]))
    at, code, weight, norm = subsequences(landmarks)
    codes = np.unique(code)  # subsequences of landmarks; all others weigh nothing
    table = np.zeros((len(landmarks), len(codes)), np.float32)
    np.add.at(table, (at, np.searchsorted(codes, code)), weight / norm[at])
    values, vectors = np.linalg.eigh((table @ table.T).astype(np.float64))
    good = values > 1e-4 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # features of a word: root' times its kernel with the landmarks

    def features(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), root.shape[1]))
        for a in range(0, len(words), 1_000):
            at, code, weight, norm = subsequences(words[a:a + 1_000])
            col = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            known = codes[col] == code
            own = np.zeros((len(norm), len(codes)), np.float32)
            np.add.at(own, (at[known], col[known]), weight[known])
            out[a:a + 1_000] = (own @ table.T) / norm[:, None] @ root
        return out

    model = nothing
    for _ in range(ROUNDS):
        negative = list(dict.fromkeys(negative))
        x = features(positive + negative)
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        cost = np.where(y > 0, len(negative) / len(positive), 1.0) * COST
        w = _squared_hinge(x, y, cost)
        weights = np.zeros(CODES ** 3, np.float32)
        weights[codes] = root @ w[:-1] @ table
        model = Model(weights, float(w[-1]), 0.0, 0.0)
        scores = np.concatenate([model.words(clean[a:a + 50_000]) for a in range(0, len(clean), 50_000)])
        hard = np.argsort(-scores)[:PER_ROUND]
        negative += [clean[k] for k in hard if scores[k] > -1]
        positive += [w for w, x in zip(candidates, model.words(candidates), strict=True) if x > 0.5 and w not in positive]
    scorer = Scorer(model)
    largest = np.concatenate([scorer.largest([t for t, _ in rows[a:a + 500]]) for a in range(0, len(rows), 500)])
    y = np.array([y for _, y in rows], np.float64)
    model.slope, model.level = _platt(largest, y)
    return model


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of the log odds by regularised Newton steps, on targets drawn in from 0 and 1; classes weigh alike."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
    x = np.column_stack([score, np.ones(len(y))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every whole text (null: empty). The model has one size whatever it was fitted on."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = hash((model.weights.tobytes(), model.bias, model.slope, model.level))

    def make():
        scorer = held("scorer", key, lambda: Scorer(sent.value))

        def one(batch: pa.RecordBatch):
            ids, text = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            p = np.concatenate([scorer.model.probability(scorer.largest(text[k])) for k in parts(text)])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

        return one

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")


def labelled(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> list[tuple[str, int]]:
    """At most so many labelled texts of either class, those of lowest hash of the doc_id, and ROW_CHARS characters of each. A
    document labelled more than once is toxic if any label says so; of rows with the same doc_id the least text is taken; null
    labels, ids and texts are left out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, toxic_rows), (0, clean_rows))]
    picked = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most toxic_rows + clean_rows rows
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.substring("text", 1, ROW_CHARS)).alias("text")).collect()
    return sorted((r["text"], int(r["toxic"])) for r in rows)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(labelled(docs, labels.filter(~held_out(3, 1))))
    found = score(docs, model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
