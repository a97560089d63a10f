"""Operator 4: byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Tokens t1 and t2 may stand side by side if merging their bytes gives just them; a sequence is the encoding of its bytes
exactly if all its neighbours may. So each prefix of a text has one last token. The transducer reads bytes; its
automaton's states are the suffixes that some token begins with (subsets of places where a token may be under way),
made with their transitions when first needed. Each state knows the tokens that may end there, and the one whose
neighbour allows it is taken. Places where a token may still be under way lie within one token's length; what comes
before the point where their histories meet is emitted.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from veridict.llm.common import documents, whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of what a worker keeps; when one is reached the store starts anew, results stay the same.
MOST_TRANSITIONS = 500_000
MOST_PAIRS = 600_000
MOST_PIECES = 300_000
MOST_STEPS = 200_000
#: Characters of a piece up to which it is kept.
LONGEST_PIECE = 256
#: Bytes of a piece after which its settled tokens are emitted.
FLUSH = 4096


class Vocabulary:
    """Ranked tokens with their merge trees."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.starts = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.pairs: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a byte, or where merges cannot make it."""
        if token not in self._parts:
            pieces, limit = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(pieces) > 2:
                found = [(self.ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))]
                rank, i = min(found)
                if rank >= limit:
                    break
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            self._parts[token] = (pieces[0], pieces[1]) if len(pieces) == 2 else None
        return self._parts[token]

    def made(self, token: bytes) -> bool:
        """Whether merges make the token at all."""
        return len(token) == 1 or self.parts(token) is not None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int, float]]:
        """What stands at one edge of the token while it is merged: (part, made at, gone at)."""
        out = self._edges[side].get(token)
        if out is None:
            out, part, gone = [], token, float("inf")
            while part:
                parts = self.parts(part) if len(part) > 1 else None
                out.append((part, self.ranks[part] if parts else -1, gone))
                gone, part = self.ranks[part], parts and parts[side]
            self._edges[side][token] = out
        return out

    def fit(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of the two tokens: none has both its sides there at its time."""
        edge, rank_of, known = self._edge(self.tokens[right], 0), self.ranks.get, True
        for x, made_x, gone_x in self._edge(self.tokens[left], 1):
            for y, made_y, gone_y in edge:
                rank = rank_of(x + y)
                if rank is not None and (at := max(rank, made_x, made_y)) < gone_x and at <= gone_y:
                    known = False
                    break
            if not known:
                break
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = known
        return known


class Transducer:
    """Bytes of one piece in, tokens out."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._restart()

    def _restart(self) -> None:
        self.suffixes, self.numbers, self.moves, self.endings = [b""], {b"": 0}, {}, [()]

    def _move(self, number: int, byte: int) -> int:
        suffix = self.suffixes[number] + bytes([byte])
        while suffix not in self.vocabulary.starts:
            suffix = suffix[1:]
        if suffix not in self.numbers:
            self.numbers[suffix] = len(self.suffixes)
            self.suffixes.append(suffix)
            ends = ((n, suffix[len(suffix) - n :]) for n in range(len(suffix), 0, -1))
            self.endings.append(tuple((n, self.vocabulary.ranks[t]) for n, t in ends if t in self.vocabulary.ranks and self.vocabulary.made(t)))
        self.moves[number << 8 | byte] = self.numbers[suffix]
        return self.numbers[suffix]

    def _settled(self, last: list[int], under_way: int) -> int:
        """The place up to which the histories of the last ``under_way`` + 1 places are the same."""
        tokens, places = self.vocabulary.tokens, set(range(len(last) - 1 - under_way, len(last)))
        while len(places) > 1:
            far = max(places)
            places.remove(far)
            places.add(far - len(tokens[last[far]]) if far else 0)
        return places.pop()

    def _history(self, last: list[int], place: int) -> list[int]:
        out = []
        while place:
            out.append(last[place])
            place -= len(self.vocabulary.tokens[last[place]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) >= MOST_TRANSITIONS:
            self._restart()
        moves, endings, pairs, fit = self.moves, self.endings, self.vocabulary.pairs, self.vocabulary.fit
        number, place, last, out, before = 0, 0, [-1], [], -1
        for byte in piece:
            number = moves.get(number << 8 | byte) or self._move(number, byte)
            place += 1
            for length, token in endings[number]:
                left = last[place - length] if length < place else before
                if left < 0:
                    break
                known = pairs.get(left << 32 | token)
                if fit(left, token) if known is None else known:
                    break
            else:
                raise ValueError("the vocabulary is not closed under its own merges")
            last.append(token)
            if place >= FLUSH:
                settled = self._settled(last, len(self.suffixes[number]))
                if settled:
                    emitted = self._history(last, settled)
                    out += emitted
                    before, last, place = emitted[-1], [-1, *last[settled + 1 :]], place - settled
        return out + self._history(last, place)


class _Pieces(dict):
    """Encoded pieces as little-endian 32-bit ids."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_PIECE:
            self[piece] = ids
        return ids


class Utf8Machine:
    """Incremental UTF-8: feeds of bytes in, text out; a cut character waits for its rest. Faulty bytes give U+FFFD."""

    #: Lead bytes: bytes that follow, and the range of the first of them.
    LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
    LEAD = {b: (n, low, high) for first, last, n, low, high in LEADS for b in range(first, last + 1)}

    def __init__(self):
        self.waiting = b""

    @classmethod
    def step(cls, waiting: bytes, fed: bytes) -> tuple[str, bytes]:
        """Text that is complete, and what waits."""
        out, need, low, high, value = [], 0, 0x80, 0xBF, 0
        held = b""
        for byte in waiting + fed:
            if need and low <= byte <= high:
                value, need, low, high, held = value << 6 | byte & 0x3F, need - 1, 0x80, 0xBF, held + bytes([byte])
                if not need:
                    out.append(chr(value))
                    held = b""
                continue
            if need:
                out.append("�")
                need, held = 0, b""
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in cls.LEAD:
                need, low, high = cls.LEAD[byte]
                value, held = byte & (0x3F >> need), bytes([byte])
            else:
                out.append("�")
        return "".join(out), held

    def feed(self, fed: bytes) -> str:
        text, self.waiting = self.step(self.waiting, fed)
        return text

    def end(self) -> str:
        text, self.waiting = "�" if self.waiting else "", b""
        return text


class Codec:
    """Encodes texts piece by piece and decodes ids as a stream."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = _Pieces(Transducer(self.vocabulary))
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids as far as it is complete, token by token."""
        steps, waiting = self.steps, b""
        if len(steps) > MOST_STEPS:
            steps.clear()
        for i in ids:
            found = steps.get((waiting, i))
            if found is None:
                found = steps[waiting, i] = Utf8Machine.step(waiting, self.vocabulary.tokens[i])
            text, waiting = found
            yield text
        if waiting:
            yield "�"

    def decode(self, ids: bytes) -> str:
        return "".join(self.stream(np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(2)
def codec(path: str | None = None) -> Codec:
    """One codec for each worker process. The vocabulary is installed with the workers; ``path`` names another file."""
    import public_tokenizers

    return Codec(read_ranks(path or default_path()), public_tokenizers.PATTERN)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row doc_id, ids (binary, little-endian 32-bit) and the text decoded from them.

    Null and empty texts have no ids; special tokens are ordinary text; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            for a in range(0, len(batch), 256):
                ids = [own.encode(t) for t in batch["text"].iloc[a : a + 256]]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a : a + 256].to_numpy(), "ids": ids, "decoded": [own.decode(i) for i in ids]})

    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; computed beside the ids, so that only digests leave Python.

    Null texts are empty ones, which have no ids; repeated rows get a row each; very long texts are encoded whole, piece
    by piece; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sha = codec(path), hashlib.sha256
        for batch in batches:
            rows = []
            for text in batch.pop("text"):
                ids = own.encode(text)
                rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(own.decode(ids).encode()).hexdigest()))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
