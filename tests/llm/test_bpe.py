import hashlib
import random

import pytest

from veridict.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aeiou", "ab", "éèüñabcst", ["the", "ing", " tion", "a", "b"], "0123456789", "!?.,-_=*#", " \t\n\r\x0b", "👍🏽日本語́", "'s't're'll"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.codec().vocabulary.ranks, special_tokens={})


def ids(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_as_the_library_and_back(library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(a) for _ in range(400)) for a in ALPHABETS for _ in range(10)] + ["", "<|endoftext|>", "\x00\x01", "a" * 20_000, "ab" * 9000]
    texts.append("".join(rng.choice("abcdefgh") for _ in range(30_000)))
    for text in texts:
        code = bpe.codec().encode(text)
        assert ids(code) == library.encode_ordinary(text)
        assert bpe.codec().decode(code) == text


def test_small_stores_change_nothing(library, monkeypatch):
    for name in ("MOST_TRANSITIONS", "MOST_PAIRS", "MOST_PIECES", "MOST_STEPS", "FLUSH"):
        monkeypatch.setattr(bpe, name, 50)
    own = bpe.Codec(bpe.codec().vocabulary.ranks, tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(100):
        text = "".join(rng.choice("abcdefghé ") for _ in range(300))
        assert ids(own.encode(text)) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text


def test_stream_cuts_no_character():
    machine = bpe.Utf8Machine()
    data = "aé日👍\x7f".encode()
    assert "".join([machine.feed(data[i : i + 1]) for i in range(len(data))] + [machine.end()]) == data.decode()
    for faulty in (b"\xff", b"\xc3", b"\xe2\x82", b"\xc0\x80a", b"\xed\xa0\x80", b"a\xf0\x9f\x91b", b"\xf5\x80"):
        assert bpe.Utf8Machine.step(b"", faulty)[0] + ("�" if bpe.Utf8Machine.step(b"", faulty)[1] else "") == faulty.decode(errors="replace")


def test_digests(spark, library):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (None, "x y"), (1, "Hello wörld"), (5, "word " * 5000)]
    got = bpe.digests(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")).collect()
    want = []
    for i, text in rows:
        code = library.encode_ordinary(text or "")
        want.append((i, len(code), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in code)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
