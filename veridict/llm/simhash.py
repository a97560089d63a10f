"""Operator 9: SimHash near-deduplication by Golay-code fuzzy hashing.

64 bits are cut into segments of 22, 21 and 21. Of at most four differing bits, sorted by segment, either the first
segment has none and the second two at most, or the first two have one each and the third two at most. So two linked
fingerprints share a key of the form (segment exact, Golay key of another segment) or (Golay keys of all three). Keys
of 33 bits and more keep unrelated fingerprints apart at any corpus size; candidates are verified, and only links that
hold go on to the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm import golay
from veridict.llm.common import by_group, documents, measured, shared, whole_text

WORDS_PER_SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: (first bit, bits) of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Groups of a key up to this size are compared in one vectorised pass, larger ones by growing components.
SMALL = 32
AT_ONCE = 2000


def fingerprint(text: bytes, words_per_shingle: int = WORDS_PER_SHINGLE) -> int:
    """Majority of the bits of all shingles' XXH64, repeats included; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    count = len(words) - span + 1
    ones = np.zeros(64, np.int64)
    for a in range(0, count, 1 << 16):
        b = min(count, a + (1 << 16))
        hashes = np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a + span - 1 : b + span - 1].tolist())], np.dtype(">u8"), b - a)
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = np.fromiter(map(fingerprint, batch.pop("text")), np.uint64, len(batch))
        yield batch.assign(fp=prints.view(np.int64))


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of each fingerprint (unsigned)."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    fuzzy = [golay.keys(p) for p in parts]
    rows, found, kind = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, column = np.nonzero(fuzzy[j] >= 0)
                rows.append(row)
                found.append(kind << 58 | parts[i][row] << 12 | fuzzy[j][row, column])
                kind += 1
    a, b, c = fuzzy
    all_three = (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    there = (a >= 0)[:, :, None, None] & (b >= 0)[:, None, :, None] & (c >= 0)[:, None, None, :]
    rows.append(np.nonzero(there)[0])
    found.append(kind << 58 | all_three[there])
    return np.concatenate(rows), np.concatenate(found)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = batch["fp"].to_numpy(np.int64)
        for a in range(0, len(prints), AT_ONCE):
            part = prints[a : a + AT_ONCE]
            row, key = fuzzy_keys(part.view(np.uint64))
            yield pd.DataFrame({"key": key, "fp": part[row]})


def _grown(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of each of these fingerprints to the first of its component; each is compared with those not yet placed."""
    left = prints
    while len(left) > 1:
        front, left, members = left[:1], left[1:], [left[:1]]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for a in range(0, len(front), 256):
                rest = np.flatnonzero(~near)
                for b in range(0, len(rest), 1 << 14):
                    piece = rest[b : b + (1 << 14)]
                    near[piece] = (np.bitwise_count(front[a : a + 256, None] ^ left[piece]) <= MOST_BITS).any(axis=0)
            front, left = left[near], left[~near]
            members.append(front)
        component = np.concatenate(members)
        yield np.full(len(component) - 1, component[0]), component[1:]


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in by_group(batches, "key"):
        keys, prints = batch["key"].to_numpy(), batch["fp"].to_numpy(np.int64).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        pairs = []
        end_of = np.repeat(starts + sizes, sizes)
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        for step in range(1, SMALL):
            at = at[at + step < end_of[at]]
            if not len(at):
                break
            near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= MOST_BITS]
            pairs.append((prints[near], prints[near + step]))
        for k in np.flatnonzero(sizes > SMALL):
            pairs += _grown(prints[starts[k] : starts[k] + sizes[k]])
        if pairs:
            found = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs)]), axis=1)
            yield pd.DataFrame({"u": found[0].view(np.int64), "v": found[1].view(np.int64)})


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``links(u, v)`` with the smallest node of its connected component.

    Large-star and small-star steps in turn; each round's links are written to the shared folder, nothing is collected.
    So are the least neighbours: a join with a table of its own can be split or broadcast where a node has very many links.
    """
    links = shared(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = measured(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), 16)
        large = shared(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        smallest = measured(large.groupBy("u").agg(F.min("v").alias("m")), 16)
        joined = large.join(smallest, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        links = shared(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("connected components did not settle")


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component).

    Null and empty texts have fingerprint zero and are linked as any others; equal fingerprints are one node, so copies
    cost nothing; a null id is never the smallest unless all of its component are; very long texts are read whole, a
    bounded number of shingles at a time; other columns are ignored.
    """
    prints = shared(docs.select("doc_id", F.encode(whole_text(), "UTF-8").alias("text")).mapInPandas(_fingerprints, "doc_id long, fp long"))
    nodes = shared(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    keyed = nodes.select("fp").mapInPandas(_keyed, "key long, fp long")
    links = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_links, "u long, v long")
    placed = nodes.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = shared(placed)
    smallest = measured(placed.groupBy("root").agg(F.min("first").alias("component_id")), 16)
    of_print = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near group: the one with the smallest id; of its repeated rows all stay."""
    gone = near_groups(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(measured(gone, 24), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
