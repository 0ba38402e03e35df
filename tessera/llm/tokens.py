"""Exact, vectorised driving of the ``tokenizers`` byte-level BPE.

The library spends most of its time on words it has seen before. Texts are therefore cut into pre-tokens with numpy
(the public byte-level pattern, restated as boundary rules over character classes), each distinct pre-token of a worker
goes through the library once, and the ids of a text are gathered from a bounded table of known pre-tokens.

A text that holds a character whose class is not the same in the oldest and the newest Unicode tables at hand goes
through the library whole, so a difference between Unicode versions cannot change a result.
"""

from __future__ import annotations

import os
import sys
import unicodedata

import numpy as np

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER, NUMBER, OTHER, SPACE, UNSURE = 0, 1, 2, 3, 4
#: The contractions of the byte-level pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pre-tokens longer than this many code points are passed to the library without being remembered.
LONG = 512
MARK = 0x10FFFF
#: Code points whose classes stand in a table.
PLANES = 0x30000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _class_of(c: str) -> int:
    """A character's class, UNSURE where it may not be the same in all versions of the Unicode tables: letters, numbers and
    blanks that the oldest tables do not have, and what the newest at hand do not. Signs were never of another class."""
    classes = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    new, old = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return SPACE if old[0] == "Z" or c in "\t\n\v\f\r\x85" else UNSURE
    found = classes.get(new[0], OTHER)
    if new in ("Cn", "Zs") or found != classes.get(old[0], OTHER):
        return UNSURE
    return OTHER if found == SPACE else found


def class_table() -> np.ndarray:
    """The class of the code points of the first three planes; a last entry stands for those beyond, which are UNSURE."""
    table = np.full(PLANES + 1, UNSURE, np.uint8)
    for k in range(PLANES):
        if not 0xD800 <= k < 0xE000:
            table[k] = _class_of(chr(k))
    return table


def classes_of(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(points, PLANES)]


def boundaries(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. ``first`` flags the first code point of each text; texts never share a pre-token."""
    n = len(points)
    prev, nxt = np.empty(n, np.uint8), np.empty(n, np.uint8)
    prev[1:], nxt[:-1] = kind[:-1], kind[1:]
    prev[0], nxt[-1] = SPACE, SPACE
    last = np.empty(n, bool)
    last[:-1], last[-1] = first[1:], True
    space, blank = kind == SPACE, points == 32
    after_blank = np.empty(n, bool)
    after_blank[1:], after_blank[0] = blank[:-1], False
    start = np.where(space, (prev != SPACE) | ((nxt != SPACE) & ~last), np.where(prev == SPACE, ~after_blank, kind != prev))
    start |= first
    for p in np.flatnonzero((points == 39) & start):
        if p + 1 < n and not first[p + 1]:
            ends = next((len(c) for c in CONTRACTIONS if _spells(points, first, p + 1, c)), 0)
            if ends:
                start[p + 1] = False
                if ends == 2:
                    start[p + 2] = False
                if p + 1 + ends < n:
                    start[p + 1 + ends] = True  # letters that run on from a contraction start afresh
    return start


def _spells(points: np.ndarray, first: np.ndarray, at: int, word: str) -> bool:
    if at + len(word) > len(points):
        return False
    return all(points[at + k] == ord(c) and not first[at + k] for k, c in enumerate(word))


class WordEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` of a byte-level BPE file does.

    path: the tokenizer file. known: most pre-tokens remembered per worker; beyond it, the table starts again.
    """

    def __init__(self, path: str, known: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table, self.known, self.alphabet = class_table(), known, byte_alphabet()
        self.decoder = None
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        """The plain path: the library on the whole text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one more entry than texts)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(len(texts) + 1, np.int64)
        if not len(points):
            return np.empty(0, np.uint32), out
        ends = np.cumsum(sizes)
        begins = ends - sizes
        kind = classes_of(points, self.table)
        odd = np.zeros(len(texts), bool)
        unsure = np.flatnonzero(kind == UNSURE)
        if len(unsure):
            odd[np.unique(np.searchsorted(ends, unsure, "right"))] = True
        for s in self.special:
            odd |= np.fromiter((s in t for t in texts), bool, len(texts))
        first = np.zeros(len(points), bool)
        first[begins[sizes > 0]] = True
        start = boundaries(points, kind, first)
        at = np.flatnonzero(start)
        length = np.diff(np.append(at, len(points)))
        text_of = np.searchsorted(ends, at, "right")
        plain = ~odd[text_of] & (length <= LONG)
        ids, count = self.gather(points, at[plain], length[plain])
        rest = np.flatnonzero(~plain & ~odd[text_of])
        parts = np.zeros(len(at), np.int64)
        parts[plain] = count
        if not odd.any() and not len(rest):
            out[1:] = np.cumsum(np.bincount(text_of, count, len(texts)).astype(np.int64)) if len(at) else 0
            return ids, out
        # the slow remainder, placed between what was gathered
        given = {}
        for k in rest:
            given[int(k)] = self.whole(points[at[k]:at[k] + length[k]].tobytes().decode("utf-32-le", "surrogatepass"))
            parts[k] = len(given[int(k)])
        per_text = np.bincount(text_of, parts, len(texts)).astype(np.int64)
        odd_ids = {int(i): self.whole(texts[i]) for i in np.flatnonzero(odd)}
        for i, x in odd_ids.items():
            per_text[i] = len(x)
        out[1:] = np.cumsum(per_text)
        full = np.empty(out[-1], np.uint32)
        for i, x in odd_ids.items():
            full[out[i]:out[i + 1]] = x
        keep = ~odd[text_of]
        where = np.cumsum(parts * keep) - parts * keep
        shift = np.zeros(len(texts), np.int64)
        firsts = np.searchsorted(text_of, np.arange(len(texts)))
        ok = (firsts < len(at)) & ~odd & (sizes > 0)
        shift[ok] = out[:-1][ok] - where[firsts[ok]]
        place = where + shift[text_of]
        full[np.repeat(place[plain] - (np.cumsum(count) - count), count) + np.arange(len(ids))] = ids
        for k, x in given.items():
            full[place[k]:place[k] + len(x)] = x
        return full, out

    def gather(self, points: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        key = self._hash(points, at, length)
        # distinct words first: most lookups of a batch are for a few words
        uniq, seen, back = np.unique(key, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.hashes, uniq)
        hit = np.zeros(len(uniq), bool)
        inside = pos < len(self.hashes)
        hit[inside] = self.hashes[pos[inside]] == uniq[inside]
        if not hit.all():
            if len(self.hashes) + np.count_nonzero(~hit) > self.known:
                self._clear()
                hit[:] = False
            self._learn(points, at, length, uniq[~hit], seen[~hit])
            pos = np.searchsorted(self.hashes, uniq)
        begin, count = self.at[pos][back], self.size[pos][back]
        total = np.cumsum(count)
        return self.pool[np.repeat(begin - (total - count), count) + np.arange(total[-1])], count

    @staticmethod
    def _hash(points: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """64 bits of each pre-token: a sum of mixed (character, place) values, finished with its length."""
        place = np.arange(len(points), dtype=np.uint64)
        starts = np.repeat(at, length)
        if len(starts) == len(points):
            p, q = points.astype(np.uint64), place - starts.astype(np.uint64)
        else:
            idx = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())
            p, q = points[idx].astype(np.uint64), (idx - starts).astype(np.uint64)
        x = (p + (q << np.uint64(21)) + np.uint64(1)) * _MULT
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        ends = np.cumsum(length)
        return np.add.reduceat(x, ends - length) + length.astype(np.uint64)

    def _learn(self, points, at, length, hashes, first) -> None:
        pool, size = self._through_library(points, at[first], length[first])
        begin = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, pool])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.size = hashes[order], np.concatenate([self.at, begin])[order], np.concatenate([self.size, size])[order]

    def _through_library(self, points, at, length) -> tuple[np.ndarray, np.ndarray]:
        """The library's model on each word, spelt in the byte-level alphabet. MARK stands between words: it is UNSURE,
        so no word holds it, and its UTF-8 becomes a byte that UTF-8 never has."""
        gap = length + 1
        ends = np.cumsum(gap)
        joined = np.full(ends[-1], MARK, np.uint32)
        total = np.cumsum(length)
        step = np.arange(total[-1])
        joined[np.repeat(ends - gap - (total - length), length) + step] = points[np.repeat(at - (total - length), length) + step]
        spelt = joined.tobytes().decode("utf-32-le").encode().replace(chr(MARK).encode(), b"\xff").decode("latin-1").translate(self.alphabet)
        tokenize, ids, size = self.tokenizer.model.tokenize, [], []
        for word in spelt[:-1].split(self.alphabet[0xFF]):
            found = tokenize(word)
            ids += [t.id for t in found]
            size.append(len(found))
        return np.array(ids, np.uint32), np.array(size, np.int64)


def byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    return held("encoder", path, lambda: WordEncoder(path))


def default_path() -> str:
    """The tokenizer file of the contracts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def little_endian(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes() if sys.byteorder != "little" else np.ascontiguousarray(ids, np.uint32).tobytes()
