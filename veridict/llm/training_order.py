"""Operator 10: training-order materialisation. Texts become token sequences of one length; a keyed Feistel permutation
gives each a global slot; partitions are ranges of slots, and write shards of consecutive slots as files with a fixed
stride, read by offset."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.bpe import default_path, read_ranks
from veridict.llm.common import documents, files, shared, shared_folder, whole_text

#: Tokens of a sequence, and sequences of a shard.
TOKENS, PER_SHARD = 256, 16_384
#: A partition is one shard up to so many shards, and several consecutive ones beyond.
MOST_RANGES = 50_000
KEY = 0x5EED
ROUNDS = 6
#: The vocabularies' pattern, and one that cuts alike with less backtracking.
PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s++$|\s+(?!\S)|\s"}
#: What the patterns call blank, and the length from which on runs of it are cut by hand where the pattern's stack is too small.
BLANKS, LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++"), 1000
#: tiktoken's buffers come with a search for special tokens, where none at all would match everywhere; this one is not allowed, so it is ordinary text.
NEVER, ALLOWED = "\0\0never\0\0", frozenset()


class Permutation:
    """A keyed permutation of 0 .. n - 1: Feistel rounds on the next even number of bits, walked until within range."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little")) for i in range(ROUNDS)]

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ x >> np.uint64(29)) & self.mask

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x, shift = np.asarray(x, np.uint64).copy(), np.uint64(self.half)
        todo = np.arange(len(x))
        while len(todo):
            left, right = x[todo] >> shift, x[todo] & self.mask
            for key in self.keys[::-1] if back else self.keys:
                left, right = (right ^ self._mixed(left, key), left) if back else (right, left ^ self._mixed(right, key))
            x[todo] = left << shift | right
            todo = todo[x[todo] >= self.n]
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


@lru_cache(2)
def _tokenizer(path: str | None):
    import public_tokenizers
    import tiktoken

    ranks, pattern = read_ranks(path or default_path()), public_tokenizers.PATTERN
    return tiktoken.Encoding("own", pat_str=PATTERNS.get(pattern, pattern), mergeable_ranks=ranks, special_tokens={NEVER: max(ranks.values()) + 1})


def without_long_blanks(text: str) -> list[str]:
    """The text cut around its long runs of blanks, where the pattern cuts too: before them, and before the last blank,
    which belongs to what follows. A run at the end is one piece."""
    parts, at = [], 0
    for run in BLANKS.finditer(text):
        start, end = run.span()
        if end - start >= LONG_RUN and end < len(text):
            parts += [text[at:start], text[start : end - 1]]
            at = end - 1
    return [*parts, text[at:]]


def token_ids(text: str, path: str | None = None) -> np.ndarray:
    """Ids of a whole text, without special tokens."""
    encode = _tokenizer(path)._core_bpe.encode_to_tiktoken_buffer
    try:
        return np.frombuffer(encode(text, ALLOWED), np.uint32)
    except ValueError:
        parts = without_long_blanks(text)
        if len(parts) == 1:
            raise
        return np.concatenate([np.frombuffer(encode(part, ALLOWED), np.uint32) for part in parts])


def filling(path: str | None = None) -> int:
    """The first id that the vocabulary leaves free."""
    return max(read_ranks(path or default_path()).values()) + 1


def write_whole(folder: str, name: str, data: bytes) -> None:
    """A file that is there whole or not at all; a task that is run again replaces it by the same bytes."""
    system, at = files(folder)
    system.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{at}/{name}")


def read_slots(folder: str, first: int, count: int) -> np.ndarray:
    """Sequences of consecutive slots, (count, tokens): a reader that stopped goes on from any slot."""
    system, at = files(folder)
    with system.open_input_file(f"{at}/order.json") as got:
        order = json.loads(got.read())
    stride, out = order["bytes"] * order["tokens"], []
    last = min(first + count, order["sequences"])
    while first < last:
        shard, inside = divmod(first, order["per_shard"])
        n = min(last - first, order["per_shard"] - inside)
        with system.open_input_file(f"{at}/shard-{shard:08d}.bin") as got:
            out.append(got.read_at(n * stride, inside * stride))
        first += n
    return np.frombuffer(b"".join(out), f"<u{order['bytes']}").reshape(-1, order["tokens"])


def materialise(docs: DataFrame, folder: str, key: int = KEY, tokens: int = TOKENS, per_shard: int = PER_SHARD, path: str | None = None, fixed: bool = False) -> DataFrame:
    """Writes the shards and their index to ``folder``, then ``order.json``, and returns the index: per sequence slot,
    shard, byte_offset, doc_id, part, n_tokens.

    A sequence's number is its place in the input, its partition's start added; so partitions must have the same rows
    when read again. Tables read from files have (``fixed``); others are first written to the shared folder. Numbers and
    a checksum are compared before any range is written. A text without tokens (null, empty) makes no sequence; a very
    long one makes as many as it needs; repeated rows are materialised each; other columns are ignored. Sequences are
    filled up with the vocabulary's first free id; ids are of two bytes where that fits, else of four.
    """
    fill = filling(path)
    width = 2 if fill < 1 << 16 else 4
    stride = width * tokens
    docs = docs.select("doc_id", whole_text().alias("text"))
    docs = docs if fixed else shared(docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, check = 0, 0
        for batch in batches:
            for text in batch["text"]:
                had = len(token_ids(text, path))
                n, check = n - (-had // tokens), (check * 1000003 + had) & 0x7FFFFFFF
        yield pd.DataFrame({"partition": [TaskContext.get().partitionId()], "n": [n], "check": [check]})

    counted = sorted(docs.mapInPandas(count, "partition int, n long, check long").collect())  # one row a partition
    starts, checks, total = {}, {}, 0
    for p, n, check in counted:
        starts[p], checks[p], total = total, check, total + n
    context = docs.sparkSession.sparkContext
    known = context.broadcast((starts, checks))
    order = Permutation(max(1, total), key)
    shards = max(1, -(-total // per_shard))
    ranges = min(shards, MOST_RANGES)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TaskContext.get().partitionId()
        fills = np.full(tokens, fill, f"<u{width}").tobytes()
        number, check = known.value[0].get(own, 0), 0
        for batch in batches:
            for low in range(0, len(batch), 1000):
                some = batch.iloc[low : low + 1000]
                counts, had, payload = [], [], []
                for text in some["text"]:
                    found = token_ids(text, path)
                    n = len(found)
                    check = (check * 1000003 + n) & 0x7FFFFFFF
                    sequences = -(-n // tokens)
                    data = found.astype(f"<u{width}").tobytes() + fills[: width * (sequences * tokens - n)]
                    counts.append(sequences)
                    if sequences:
                        had += [tokens] * (sequences - 1)
                        had.append(n - (sequences - 1) * tokens)
                        payload += [data[a : a + stride] for a in range(0, len(data), stride)]
                firsts = np.cumsum(counts) - counts
                slots = order.slots(np.arange(number, number + len(had), dtype=np.uint64))
                number += len(had)
                parts = np.arange(len(had)) - np.repeat(firsts, counts)
                yield pd.DataFrame({"slot": slots, "doc_id": some["doc_id"].astype("Int64").repeat(counts).array, "part": parts, "n_tokens": np.array(had, np.int64), "payload": pd.Series(payload, dtype=object)})
        if check != known.value[1].get(own, 0):
            raise RuntimeError("the input's partitions changed between two reads")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = None, []
        for batch in batches:
            of = batch["slot"].to_numpy() // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and of[a] != shard:
                    if held:
                        write_whole(folder, f"shard-{shard:08d}.bin", b"".join(held))
                    shard, held = int(of[a]), []
                held += batch["payload"].iloc[a:b].tolist()
            yield pd.DataFrame({"slot": batch["slot"], "shard": of, "byte_offset": batch["slot"] % per_shard * stride, "doc_id": batch["doc_id"], "part": batch["part"], "n_tokens": batch["n_tokens"]})
        if held:
            write_whole(folder, f"shard-{shard:08d}.bin", b"".join(held))

    placed = docs.mapInPandas(place, "slot long, doc_id long, part long, n_tokens long, payload binary")
    # slots are even over their range, so ranges of shards are even without a sample of them
    by_range = placed.repartitionById(ranges, F.floor(F.floor(F.col("slot") / per_shard) * ranges / shards).cast("int")).sortWithinPartitions("slot")
    written = by_range.mapInPandas(write, "slot long, shard long, byte_offset long, doc_id long, part long, n_tokens long")
    written.write.mode("overwrite").parquet(f"{folder}/index")
    write_whole(folder, "order.json", json.dumps({"sequences": total, "tokens": tokens, "bytes": width, "fill": fill, "per_shard": per_shard, "key": key, "rounds": ROUNDS}).encode())
    return docs.sparkSession.read.schema(written.schema).parquet(f"{folder}/index")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}", fixed=True)
