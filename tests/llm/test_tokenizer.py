import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import tokenizer

PATH = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = ["", " ", "\n\n  \t", "Hello world, it's  fine.  ", "<|endoftext|> [PAD]", "日本語 العربية 👩‍🔬 é", "a" * 3000, " " * 500 + "x", "x\r\ny z", "   b", "1234567890" * 50, "don’t I'LL we've", "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]


@pytest.fixture(scope="module")
def enc():
    return tokenizer.PrefixEncoder(tokenizer.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(enc, other, text):
    assert enc.encode(text) == other.encode_ordinary(text) and enc.decode(enc.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(enc, other, text):
    assert enc.encode(text) == other.encode_ordinary(text)


PIECES = st.lists(st.sampled_from(["'", "'l", "l", "'ll", "s", " ", "  ", "\n", "\t ", "don't", "I'LL", "word", " 12", "3", "!", "?!", "é", "日本", "\u00a0", "👩", "-", "t"]), max_size=12).map("".join)


@settings(max_examples=1500, deadline=None)
@given(PIECES, PIECES, PIECES, PIECES)
def test_appends_and_edits_equal_whole_texts(enc, other, a, b, c, new):
    """Against the tokenizer on the whole new text."""
    e = tokenizer.EncodedText(enc, a + b + c)
    assert e.ids == other.encode_ordinary(a + b + c)
    e.replace(len(a), len(a + b), new)
    assert e.text == a + new + c and e.ids == other.encode_ordinary(a + new + c)
    e.append(b)
    assert e.text == a + new + c + b and e.ids == other.encode_ordinary(e.text)


def test_long_edit_is_followed_only_nearby(enc, other):
    e = tokenizer.EncodedText(enc, "the quick brown fox jumps over the lazy dog " * 200)
    e.replace(100, 105, "zebra")
    assert e.encoded < 30 and e.ids == other.encode_ordinary(e.text)
    e = tokenizer.EncodedText(enc, "a" * 3000)
    e.append("bcd")
    assert e.encoded == 3 and e.ids == other.encode_ordinary(e.text)


def test_reposts(spark, other):
    texts = ["Hello there,  my friend's dog", "hello THERE my friends dog!", "Hello there,  my friend's dog", None, "", "?!", "?!", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("t", F.lit(1))
    got = {r["doc_id"]: r for r in tokenizer.reposts(df, "doc_id", "text", PATH).collect()}
    assert set(got) == {1, 2} and all(r["original"] == 0 and list(r["ids"]) == other.encode_ordinary(texts[i]) for i, r in got.items()) and got[2]["n_encoded"] == 0
    assert tokenizer.reposts(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_corpus(spark, enc):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, " ", "x"), (5, "long " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokenizer.encode_corpus(df, "doc_id", "text", PATH).collect())
    assert got == sorted((i, enc.encode(t) if t else []) for i, t, _ in rows) and got[1][1] == [] and got[4][1] != []
    assert tokenizer.encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
