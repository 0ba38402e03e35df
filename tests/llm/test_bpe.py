import hashlib
import random

import numpy as np
import pytest

from tessera.llm.bpe import Decoder, Leaf, encode_tree, encode_word, join_leaves, round_trips
from tessera.llm.tokens import WordEncoder, default_path

ALPHABET = "ab A1²Ⅷ  \n\n\r\t.,'’sdtrevmlL!?é中😀​\xa0\x1c"


@pytest.fixture(scope="module")
def enc():
    return WordEncoder(default_path(), known=500)


def ids_of(enc, text):
    return enc.tokenizer.encode(text, add_special_tokens=False).ids


def drawn(rng, n, alphabet=ALPHABET):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))


def test_table_encoding_equals_the_library(enc):
    rng = random.Random(1)
    for _ in range(60):
        batch = [drawn(rng, 40) for _ in range(20)] + ["", "  ", "x  ", "<|endoftext|>a", "we're  'sup 'll it's\n's", "a" * 700]
        ids, at = enc.encode(batch)
        for k, t in enumerate(batch):
            assert ids[at[k]:at[k + 1]].tolist() == ids_of(enc, t), t


def test_leaves_joined_equal_the_library(enc):
    rng = random.Random(2)
    for k in range(150):
        text = drawn(rng, 900, ALPHABET[:5] + " \n.'sdtrevml" if k % 2 else "ab  \n'st.é")
        cut = sorted(rng.sample(range(len(text) + 1), min(len(text), 3)))
        leaves = [Leaf(enc, text[a:b]) for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]
        assert encode_tree(enc, leaves).tolist() == ids_of(enc, text), text


def test_joined_leaf_can_be_joined_again(enc):
    text = "It's a test, isn't it?  " * 60
    a, b, c = text[:401], text[401:817], text[817:]
    whole = join_leaves(enc, join_leaves(enc, Leaf(enc, a), Leaf(enc, b)), Leaf(enc, c))
    assert whole.ids.tolist() == ids_of(enc, text) and whole.text == text
    assert np.array_equal(whole.starts, Leaf(enc, text).starts) and np.array_equal(whole.at, Leaf(enc, text).at)


@pytest.mark.parametrize("alphabet", ["ab", "a", "thenigors", "éüaß"])
def test_unsplit_words_through_the_tree(enc, alphabet):
    rng = random.Random(3)
    for n in (600, 3000):
        word = "".join(rng.choice(alphabet) for _ in range(n))
        assert encode_word(enc, word, leaf=64) == ids_of(enc, word)


def test_query_rows(spark, enc):
    rows = [(1, None), (2, ""), (3, "short 😀 <|endoftext|>"), (3, "short 😀 <|endoftext|>"), (4, "word's end. " * 500), (5, "x" * 5000), (None, "y\n\n z")]
    got = round_trips(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS leaf"), default_path(), leaf=300).collect()
    want = []
    for d, t in rows:
        ids = ids_of(enc, t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_decoding_of_cut_characters(enc):
    ids = ids_of(enc, "😀中")
    assert Decoder(enc).decode(np.array(ids[:-1])) == enc.tokenizer.decode(ids[:-1], skip_special_tokens=False)


def test_empty_table(spark):
    assert round_trips(spark.createDataFrame([], "doc_id long, text string"), default_path()).collect() == []


def test_signs_beyond_the_first_plane_are_table_encoded(enc):
    """Emoji and other signs are classed alike in all Unicode tables, so long texts with them go through the tree."""
    rng = random.Random(8)
    signs = "😀🎉𝄞🤖👩‍🚀𠀀𐍈"
    assert all(Leaf(enc, c).sure for c in signs)
    for _ in range(40):
        text = drawn(rng, 600, ALPHABET[:8] + signs)
        leaves = [Leaf(enc, text[a:a + 150]) for a in range(0, len(text), 150)]
        assert all(x.sure for x in leaves) and encode_tree(enc, leaves).tolist() == ids_of(enc, text)
    sample = [chr(k) for k in range(0x20, 0x30000, 37) if enc.table[k] != 4]
    batch = [f"a{c}1{c} {c}{c}a  {c}'s{c}\n{c}" for c in sample]
    ids, at = enc.encode(batch)
    assert all(ids[at[k]:at[k + 1]].tolist() == ids_of(enc, t) for k, t in enumerate(batch))
