"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, documents, held, held_out, map_batches, parts

#: Characters of labelled text per language that a model is built from: a bounded sample, the rows of lowest hash.
SAMPLE_CHARS = 120_000
#: Rows per language that may reach the driver while the sample is drawn, and code points of one of them.
SAMPLE_ROWS, ROW_CHARS = 400, 2_000
UNKNOWN = "und"
#: Characters, the commonest of the models' texts, whose transitions stand in a table by state; others' are looked up.
DENSE = 96
#: Texts are parsed side by side until so few of them are left; these go on one by one.
SIDE_BY_SIDE = 12


class SuffixAutomaton:
    """All substrings of a text, for longest matches in one step per character (Blumer et al.)."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            last = self._extend(last, c)

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p == -1:
            return new
        q = nxt[p][c]
        if length[p] + 1 == length[q]:
            link[new] = q
            return new
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = link[new] = copy
        return new

    def phrases(self, text: str) -> int:
        """Phrases of the cross parsing: each is the longest substring of the model's text that starts where the one before
        ended, or a single character that the model's text lacks."""
        nxt, count, state = self.next, 0, 0
        for c in text:
            to = nxt[state].get(c)
            if to is None:
                count += 1
                to = nxt[0].get(c)
                if to is None:  # a phrase of its own
                    count += state != 0
                    state = 0
                    continue
                if state == 0:
                    count -= 1
            state = to
        return count + (state != 0)


def _kinds() -> np.ndarray:
    """1 for letters, 2 for blanks, 0 for what is left out, by code point."""
    table = np.zeros(0x110000, np.uint8)
    for k in range(0x110000):
        c = chr(k)
        table[k] = 1 if c.isalpha() else 2 if c.isspace() else 0
    return table


def letters(text: str, kinds: np.ndarray) -> np.ndarray:
    """The code points that are parsed of a text: its letters in lower case, words between single blanks; none without a
    letter. A word without a letter leaves no second blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    points, kind = np.where(kind == 2, 32, points)[kind > 0], kind[kind > 0]
    if not (kind == 1).any():
        return points[:0]
    blank = np.concatenate([[True], kind == 2, [True]])
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    return points[~(blank & np.concatenate([[False], blank[:-1]]))]


def clean(text: str, kinds: np.ndarray) -> str:
    """The same as text, without the first blank."""
    return letters(text, kinds).tobytes().decode("utf-32-le", "surrogatepass")[1:]


def sample(labelled: DataFrame) -> dict[str, str]:
    """Text per language, from ``labelled`` (text, lang; both not null): rows in the order of a hash of their distinct
    normalised beginnings, at most SAMPLE_ROWS rows and SAMPLE_CHARS characters each language."""
    from pyspark.sql import Window

    rows = labelled.select("lang", F.substring("text", 1, ROW_CHARS).alias("text")).filter(F.length(F.trim("text")) > 0)
    # a bounded number of rows of each part of the input, then of all: no task ranks all rows of a language
    rows = rows.withColumn("h", F.xxhash64("text"))
    for group in (["lang", F.pmod("h", F.lit(256))], ["lang"]):
        n = SAMPLE_ROWS if len(group) == 1 else max(8, SAMPLE_ROWS // 64)
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("h", "text"))).filter(F.col("r") <= n).drop("r")
    found: dict[str, list[str]] = {}
    kinds = _kinds()
    for r in rows.dropDuplicates(["lang", "text"]).orderBy("lang", "h", "text").collect():
        found.setdefault(r["lang"], []).append(clean(r["text"], kinds))
    return {lang: " " + "".join(x)[:SAMPLE_CHARS] for lang, x in found.items() if any(x)}


def purified(samples: dict[str, str]) -> dict[str, str]:
    """The samples without words that are much commoner in another language's sample: labelled text holds foreign passages."""
    share = {}
    for lang, text in samples.items():
        words, counts = np.unique(text.split(), return_counts=True)
        share[lang] = dict(zip(words.tolist(), (counts / counts.sum()).tolist(), strict=True))
    top = {}
    for s in share.values():
        for w, x in s.items():
            top[w] = max(top.get(w, 0.0), x)
    return {lang: " " + "".join(f"{w} " for w in text.split() if 4 * share[lang][w] >= top[w]) for lang, text in samples.items()}


class Identifier:
    """Models of all languages, and the cross parsing of whole texts by all of them at once.

    Most states of an automaton have one transition, which two numbers hold; the others have a row of a table. Transitions
    are twice the next state on a hit, else twice the state that a new phrase starts in, and one more.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs, self.kinds = sorted(samples), _kinds()
        points, counts = np.unique(np.frombuffer("".join(samples.values()).encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        points = points[np.argsort(-counts, kind="stable")]
        #: 0 stands for characters that no model's text has; 1 to wide for those in the table; others follow
        self.all, self.wide = len(points) + 1, min(len(points), DENSE) + 1
        self.symbol = np.zeros(0x110000, np.min_scalar_type(self.all))
        self.symbol[points] = np.arange(1, len(points) + 1)
        # an automaton of n characters has 2 n states at most; what is never written of these takes no memory
        most = max(1, 2 * sum(map(len, samples.values())))
        table, row = np.empty((most, self.wide), np.int32), np.empty(most, np.int32)
        only, to_only = np.empty(most, np.int32), np.empty(most, np.int32)
        rare, roots, at, rows = [], [], 0, 0
        for lang in self.langs:
            edges_of = SuffixAutomaton(samples[lang]).next
            miss = rows
            table[miss] = 2 * at + 1
            for c, to in edges_of[0].items():
                if (k := int(self.symbol[ord(c)])) < self.wide:
                    table[miss, k] = 2 * (at + to) + 1
            rows += 1
            for state, edges in enumerate(edges_of):
                row[at + state], only[at + state], to_only[at + state] = miss, -1, 0
                if len(edges) == 1:
                    (c, to), = edges.items()
                    only[at + state], to_only[at + state] = self.symbol[ord(c)], 2 * (at + to)
                elif edges:
                    table[rows], row[at + state] = table[miss], rows
                    for c, to in edges.items():
                        if (k := int(self.symbol[ord(c)])) < self.wide:
                            table[rows, k] = 2 * (at + to)
                        else:
                            rare.append(((at + state) * self.all + k, 2 * (at + to)))
                    rows += 1
            roots.append(at)
            at += len(edges_of)
            del edges_of
        self.table, self.row, self.only, self.to_only = table[:rows], row[:at], only[:at], to_only[:at]
        self.roots = np.array(roots, np.int64)
        rare.sort()
        self.rare = np.array([k for k, _ in rare], np.int64)
        self.rare_to = np.array([t for _, t in rare], np.int32)

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states of (models, texts), doubled, odd where a phrase starts anew."""
        v = self.table[self.row[state], np.minimum(c, self.wide - 1)]
        far = np.flatnonzero(c >= self.wide)
        if len(far):
            for m, root in enumerate(self.roots):
                found = [self._rare(s * self.all + c[far]) for s in (state[m, far], root)]
                v[m, far] = np.where(found[0] >= 0, found[0], np.where(found[1] >= 0, found[1] + 1, 2 * root + 1))
        return np.where(self.only[state] == c, self.to_only[state], v)

    def _rare(self, key: np.ndarray) -> np.ndarray:
        if not len(self.rare):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
        return np.where(self.rare[at] == key, self.rare_to[at], -1)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(models, texts): phrases of each text's cross parsing by each model. Texts, as symbols, are parsed side by side, a character of
        each at a time, the longest first in line, so those that are done drop off the end."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        codes = np.concatenate([texts[i] for i in order]) if len(order) else np.zeros(0, self.symbol.dtype)
        sizes = sizes[order]
        start = np.cumsum(sizes) - sizes
        roots = self.roots[:, None]
        state = np.repeat(roots, len(texts), axis=1)
        count = np.zeros(state.shape, np.int64)
        left = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # texts longer than t
        t = 0
        while t < len(left) and left[t] > SIDE_BY_SIDE:
            m = left[t]
            v = self._step(state[:, :m], codes[start[:m] + t].astype(np.int32))
            new = (v >> 1).astype(np.int64)
            # what ends here: the phrase so far, if there is one, and a character that is a phrase of its own
            count[:, :m] += (v & 1) * ((state[:, :m] != roots).astype(np.int64) + (new == roots))
            state[:, :m] = new
            t += 1
        if t < len(left):
            flat, wide, row, only, to_only = memoryview(self.table.reshape(-1)), self.wide, *map(memoryview, (self.row, self.only, self.to_only))
            for i in range(left[t]):
                rest = codes[start[i] + t:start[i] + sizes[i]].tolist()
                for m, root in enumerate(self.roots.tolist()):
                    s, n = int(state[m, i]), 0
                    for c in rest:
                        v = to_only[s] if only[s] == c else flat[row[s] * wide + c] if c < wide else self._rare_one(s, c, root)
                        new = v >> 1
                        if v & 1:
                            n += (s != root) + (new == root)
                        s = new
                    state[m, i], count[m, i] = s, count[m, i] + n
        count += state != roots
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def _rare_one(self, state: int, c: int, root: int) -> int:
        for s, odd in ((state, 0), (root, 1)):
            to = int(self._rare(np.array([s * self.all + c]))[0])
            if to >= 0:
                return to + odd
        return 2 * root + 1

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores of whole texts. A score says how much fewer phrases the winner needs per character than the
        runner-up, mapped to 0.5 to 1 by a logistic curve; 0 where there is nothing to parse or no model. Ties go to the first
        language by name."""
        parsed = [self.symbol[letters(t, self.kinds)] if t else self.symbol[:0] for t in texts]
        sizes = np.array([len(x) for x in parsed])
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        some = np.flatnonzero(sizes > 0) if self.langs else []
        if len(some):
            rate = self.phrases([parsed[i] for i in some]) / sizes[some]
            order = np.argsort(rate, axis=0, kind="stable")
            first = np.take_along_axis(rate, order[:1], 0)[0]
            if len(self.langs) > 1:
                second = np.take_along_axis(rate, order[1:2], 0)[0]
                margin = (second - first) / np.maximum(second, 1e-9)
            else:
                margin = np.ones(len(some))
            langs[some] = np.array(self.langs, object)[order[0]]
            scores[some] = 1 / (1 + np.exp(-25 * margin))
        return langs.tolist(), scores.tolist()


def predict(docs: DataFrame, samples: dict[str, str], *carry: str) -> DataFrame:
    """doc_id, ``carry``, lang_pred, score of every whole text. lang_pred is ``und`` (score 0) if the text is null or has no
    letter. samples: see ``sample``; it has a bounded size and is sent to every task."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(samples)
    key = tuple(sorted((k, zlib.crc32(v.encode())) for k, v in samples.items()))

    def make():
        model = held("identifier", key, lambda: Identifier(sent.value))

        def one(batch: pa.RecordBatch):
            text = [t or "" for t in batch.column(0).to_pylist()]
            for part in parts(text, 8_000_000):
                langs, scores = model.identify(text[part])
                own = [batch.column(k).slice(part.start, part.stop - part.start) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

        return one

    names = ["doc_id", *carry]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return map_batches(docs.select("text", *names), make, schema, 4 * PIECE)


def train(docs: DataFrame) -> dict[str, str]:
    """The model of the contract: learnt from text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(4, 2))
    return purified(sample(learn.select("text", "lang")))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


