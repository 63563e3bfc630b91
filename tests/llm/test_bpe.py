import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from tests.llm.helpers import empty, with_clashes
from vitaloom.llm import bpe

PATH = public_tokenizers.path(bpe.RANK_FILE)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.mark.parametrize("seed", range(6))
def test_small_leaves_equal_the_library(codec, library, monkeypatch, seed):
    """Leaves of a few characters, so that nearly every token is made by a join."""
    rng = random.Random(seed)
    alphabet = "ab'rels tv  \n\t.1²É字\U0001f600 \x1c!!aa"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        monkeypatch.setattr(bpe, "LEAF_CHARS", rng.choice([1, 2, 3, 5, 8]))
        monkeypatch.setattr(bpe, "LEAF_BYTES", rng.choice([1, 2, 3, 8]))
        monkeypatch.setattr(bpe, "WINDOW", rng.choice([1, 2, 4]))
        codec.known.clear()
        ids = codec.encode(text)
        assert list(ids) == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000 + "x", "ab" * 2000, "é字" * 800, "0" * 900, "'re" * 1500])
def test_long_runs(codec, library, text):
    assert list(codec.encode(text)) == library.encode_ordinary(text)


def test_every_plane_of_characters(codec, library):
    for code in range(0, 0x110000, 97):
        if not 0xD800 <= code < 0xE000:
            text = f"a {chr(code)} \n{chr(code)}{chr(code)}b"
            assert list(codec.encode(text)) == library.encode_ordinary(text), hex(code)


def test_rows(spark, library):
    rows = [(1, "Hello world, it's"), (1, "Hello world, it's"), (2, None), (3, ""), (None, "x" * 10_000), (4, "<|endoftext|>")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted((tuple(r)[:4] for r in bpe.round_trip(df).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(empty(spark)).count() == 0


def test_encode_then_decode_keeps_other_columns(spark):
    rows = [(1, "one two", "p"), (2, None, None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string, `odd name` string"))
    got = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in got] == [b"one two", b""]
    assert [r["odd name"] for r in got] == ["p", None]
    assert got[0].score == "x" and got[1].ids == []
