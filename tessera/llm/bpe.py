"""Encoding and decoding with a byte-level BPE file; long texts by tree concatenation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches, parts, texts
from .tokens import LONG, UNSURE, WordEncoder, boundaries, byte_alphabet, classes_of, default_path, encoder, little_endian

#: Code points of a leaf: longer texts are cut into leaves, which may be encoded by different tasks.
LEAF = 32_768
#: Bytes of a leaf inside one unsplit word.
WORD_LEAF = 2_048
#: A boundary of pre-tokens depends on no character further away than this.
REACH = 6


def encode_word(enc: WordEncoder, word: str, leaf: int = WORD_LEAF) -> list[int]:
    """The ids of one pre-token however long, by tree concatenation: halves are encoded on their own; then a window of
    tokens around the join is encoded anew and grows until the tokens on both of its edges agree with their neighbours."""
    spelt = word.encode().decode("latin-1").translate(enc.alphabet)
    return _tree(enc, spelt, leaf)


def _tokens(enc: WordEncoder, spelt: str) -> list[tuple[int, str]]:
    return [(t.id, t.value) for t in enc.tokenizer.model.tokenize(spelt)]


def _tree(enc: WordEncoder, spelt: str, leaf: int) -> list[int]:
    def half(a: int, b: int) -> list[tuple[int, str]]:
        if b - a <= leaf:
            return _tokens(enc, spelt[a:b])
        middle = (a + b) // 2
        return join_tokens(lambda x: _tokens(enc, x), half(a, middle), half(middle, b))

    return [i for i, _ in half(0, len(spelt))]


def join_tokens(encode, left: list[tuple[int, str]], right: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The encoding of two encoded halves put together. A sequence of tokens is the encoding of its text exactly if each two
    neighbours are the encoding of theirs, so agreement at the two edges of the window is agreement everywhere."""
    k = 4
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        window = encode("".join(v for _, v in left[a:]) + "".join(v for _, v in right[:b]))
        edges = []
        if a:
            edges.append((left[a - 1], window[0]))
        if b < len(right):
            edges.append((window[-1], right[b]))
        if all(encode(x[1] + y[1]) == [x, y] for x, y in edges):
            return left[:a] + window + right[b:]
        k *= 2


class Leaf:
    """An encoded run of text: the ids, where pre-tokens start (code points) and where the ids of each start."""

    def __init__(self, enc: WordEncoder, text: str):
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes_of(points, enc.table)
        self.sure = not (kind == UNSURE).any() and not any(s in text for s in enc.special)
        if not self.sure or not text:
            return
        first = np.zeros(len(points), bool)
        first[0] = True
        self.starts = np.flatnonzero(boundaries(points, kind, first))
        lengths = np.diff(np.append(self.starts, len(points)))
        plain = lengths <= LONG
        ids, some = enc.gather(points, self.starts[plain], lengths[plain])
        count = np.zeros(len(lengths), np.int64)
        count[plain] = some
        words = {k: np.array(encode_word(enc, text[self.starts[k]:self.starts[k] + lengths[k]]), np.uint32) for k in np.flatnonzero(~plain).tolist()}
        for k, w in words.items():
            count[k] = len(w)
        self.at = np.concatenate([[0], np.cumsum(count)])
        self.ids = np.empty(self.at[-1], np.uint32)
        self.ids[np.repeat(plain, count)] = ids
        for k, w in words.items():
            self.ids[self.at[k]:self.at[k + 1]] = w

    def row(self) -> tuple[bool, bytes, bytes, bytes]:
        """What a task hands on: sure, starts, at, ids."""
        if not self.sure or not self.text:
            return self.sure, b"", b"", b""
        return True, self.starts.astype("<i4").tobytes(), self.at.astype("<i4").tobytes(), little_endian(self.ids)

    @classmethod
    def of(cls, text: str, sure: bool, starts: bytes, at: bytes, ids: bytes) -> Leaf:
        out = cls.__new__(cls)
        out.text, out.sure = text, sure
        out.starts, out.at = np.frombuffer(starts, "<i4").astype(np.int64), np.frombuffer(at, "<i4").astype(np.int64)
        out.ids = np.frombuffer(ids, "<u4")
        return out


def join_leaves(enc: WordEncoder, left: Leaf, right: Leaf) -> Leaf:
    """Both texts put together, exactly: a window of text around the join, from a boundary of the left half to one of the
    right, is encoded anew and grows until its boundaries near both ends agree with the halves' own."""
    n, k = len(left.text), 64
    while True:
        a = max(0, n - k)
        b = min(len(right.text), k)
        a = int(left.starts[max(0, np.searchsorted(left.starts, a, "right") - 1)])
        later = np.searchsorted(right.starts, b)
        b = int(right.starts[later]) if later < len(right.starts) else len(right.text)
        window = Leaf(enc, left.text[a:] + right.text[:b])
        own_left = left.starts[(left.starts >= a) & (left.starts < n - REACH)] - a
        agree_left = a == 0 or len(own_left) >= 2 and np.array_equal(own_left, window.starts[window.starts < n - REACH - a])
        edge = n - a
        own_right = right.starts[(right.starts > REACH) & (right.starts < b)] + edge
        ends_plain = b == len(right.text) or not right.text[b - 1].isspace() and len(own_right) >= 2
        agree_right = ends_plain and np.array_equal(own_right, window.starts[window.starts > REACH + edge])
        if agree_left and agree_right or a == 0 and b == len(right.text):
            break
        k *= 2
    out = Leaf.__new__(Leaf)
    out.text, out.sure = left.text + right.text, True
    x, y = np.searchsorted(left.starts, a), np.searchsorted(right.starts, b)
    out.starts = np.concatenate([left.starts[:x], window.starts + a, right.starts[y:] + n])
    out.ids = np.concatenate([left.ids[:left.at[x]], window.ids, right.ids[right.at[y]:]])
    head, tail = left.at[x] + len(window.ids), right.at[y]
    out.at = np.concatenate([left.at[:x], window.at[:-1] + left.at[x], right.at[y:] - tail + head])
    return out


def encode_tree(enc: WordEncoder, leaves: list[Leaf]) -> np.ndarray:
    """The ids of the text that the leaves make up, joined in pairs. Where a character's class is in doubt, or a special
    token's text occurs, the library encodes the whole text."""
    whole = "".join(x.text for x in leaves)
    done = [x for x in leaves if x.text]
    if any(s in whole for s in enc.special) or not all(x.sure for x in done):
        return enc.whole(whole)
    while len(done) > 1:
        done = [join_leaves(enc, *done[k:k + 2]) if k + 1 < len(done) else done[k] for k in range(0, len(done), 2)]
    return done[0].ids if done else np.empty(0, np.uint32)


class Decoder:
    """ids to text as ``Tokenizer.decode(ids, skip_special_tokens=False)`` of a byte-level file does."""

    def __init__(self, enc: WordEncoder):
        back = {c: b for b, c in byte_alphabet().items()}
        special = {i: t.content for i, t in enc.tokenizer.get_added_tokens_decoder().items()}
        vocab = enc.tokenizer.get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spelt[i] = special[i].encode() if i in special else bytes(back[c] for c in token)
        self.size = np.array([len(x) for x in spelt], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(spelt), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b"", ends
        return self.pool[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes(), ends

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids)[0].decode("utf-8", "replace")


def decoder(path: str) -> Decoder:
    """The worker's decoder of a tokenizer file, which lives as long as its encoder."""
    enc = encoder(path)
    if enc.decoder is None:
        enc.decoder = Decoder(enc)
    return enc.decoder


def round_trips(docs: DataFrame, path: str, leaf: int = LEAF, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked for) of each text.

    Texts of at most ``leaf`` code points are encoded in one step. Longer ones are dealt out as leaves that are encoded by
    different tasks and joined in pairs. Null text is empty (no ids). Repeated rows each give a row.
    """
    data = texts(docs)
    short = map_batches(data.filter(F.length("text") <= leaf), lambda: _encode_short(path, with_ids), _schema(with_ids))
    long = data.filter(F.length("text") > leaf).withColumn("row", F.monotonically_increasing_id())
    count = f"int((length(text) + {leaf} - 1) / {leaf})"
    cut = long.select("row", "doc_id", F.posexplode(F.expr(f"transform(sequence(0, {count} - 1), i -> substring(text, i * {leaf} + 1, {leaf}))")).alias("leaf", "text"))
    coded = map_batches(cut.repartition("row", "leaf"), lambda: _encode_leaves(path), "row long, doc_id long, leaf int, text string, sure boolean, starts binary, at binary, ids binary")
    joined = coded.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("leaf", "text", "sure", "starts", "at", "ids"))).alias("leaves")).select("doc_id", "leaves")
    return short.unionByName(map_batches(joined, lambda: _encode_long(path, with_ids), _schema(with_ids)))


def _schema(with_ids: bool) -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")


def _row(ids: np.ndarray, decoded: bytes, with_ids: bool) -> tuple:
    try:
        decoded.decode()
    except UnicodeDecodeError:
        decoded = decoded.decode("utf-8", "replace").encode()
    raw = little_endian(ids)
    row = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest())
    return (*row, raw, decoded.decode()) if with_ids else row


def _made(doc_ids: list, rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=names if with_ids else names[:4])


def _encode_short(path: str, with_ids: bool):
    enc, dec = encoder(path), decoder(path)

    def one(batch: pa.RecordBatch):
        doc_ids, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in parts(text):
            ids, at = enc.encode(text[part])
            raw, ends = dec.bytes_of(ids)
            places = np.concatenate([[0], ends])[at].tolist()
            rows = [_row(ids[at[k]:at[k + 1]], raw[places[k]:places[k + 1]], with_ids) for k in range(len(at) - 1)]
            yield _made(doc_ids[part], rows, with_ids)

    return one


def _encode_leaves(path: str):
    enc = encoder(path)

    def one(batch: pa.RecordBatch):
        sure, starts, at, ids = zip(*(Leaf(enc, x).row() for x in batch.column(3).to_pylist()), strict=True)
        more = [pa.array(sure), *(pa.array(x, pa.binary()) for x in (starts, at, ids))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=["row", "doc_id", "leaf", "text", "sure", "starts", "at", "ids"])

    return one


def _encode_long(path: str, with_ids: bool):
    enc, dec = encoder(path), decoder(path)

    def one(batch: pa.RecordBatch):
        for d, leaves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode_tree(enc, [Leaf.of(*(x[k] for k in ("text", "sure", "starts", "at", "ids"))) for x in leaves])
            yield _made([d], [_row(ids, dec.bytes_of(ids)[0], with_ids)], with_ids)

    return one


def op7_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir), default_path())


__all__ = ["Decoder", "encode_tree", "encode_word", "join_leaves", "op7_bpe_round_trip", "round_trips"]
