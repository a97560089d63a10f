"""Operator 2: removal of repeated byte strings by suffix arrays of shards.

Two equal strings of ``length`` bytes have the same least gram hash. So the windows of a text are cut into runs with the
same least hash, and only runs that share it with another are looked at further: equal runs (by digest) are settled by
counting, and one of each goes to the shard of its hash. A shard's suffix array finds the windows that runs share. The
runs of a hash too frequent for one shard are spread over several, whose sorted window digests are merged afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm import suffix_array
from veridict.llm.common import by_group, documents, stored, whole_text

LENGTH = 400
#: Long enough that prose shares such a string by copying only, so few runs are candidates by chance.
GRAM = 64
#: Windows in a run at most; longer runs are cut.
MOST_WINDOWS = 2048
#: Windows of a text that are looked at together: the memory that a very long text takes.
WINDOWS_AT_ONCE = 1 << 20
#: Bytes of a shard, and of one hash's runs from which on they are spread.
SHARD_BYTES = 1 << 20
#: Stands for a null id within keys.
NO_ID = -(1 << 63)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Base of the rolling hash, and places whose powers are kept.
BASE, PLACES = 0x9E3779B97F4A7C15, 1 << 16


@lru_cache(2)
def _powers(base: int, n: int = PLACES) -> np.ndarray:
    out, known = np.ones(n, np.uint64), 1
    while known < n:
        more = min(known, n - known)
        out[known : known + more] = out[:more] * np.uint64(pow(base, known, 1 << 64))
        known += more
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes: a polynomial from sums of prefixes, then mixed. It only chooses
    candidates, equal bytes have equal hashes at any place."""
    count = len(data) - gram + 1
    out = np.empty(count, np.uint64)
    up, down = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))
    for low in range(0, count, PLACES - gram):
        part = data[low : low + PLACES - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(part)], out=sums[1:])
        own = min(PLACES - gram, count - low)
        out[low : low + own] = (sums[gram : gram + own] - sums[:own]) * down[:own]
    out ^= out >> np.uint64(32)
    out *= MIX[1]
    out ^= out >> np.uint64(29)
    return out


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, least hash, whether that hash stands twice in the run) of a text's runs."""
    data = np.frombuffer(text, np.uint8)
    hashes = gram_hashes(data, gram)
    span = length - gram + 1
    count = len(hashes) - span + 1
    blocks = -(-len(hashes) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(hashes)] = hashes
    square = padded.reshape(blocks, span)
    forward = np.minimum.accumulate(square, axis=1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:count], forward[span - 1 : span - 1 + count])
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.diff(np.append(starts, count))
    if sizes.max() > MOST_WINDOWS:
        cuts = np.concatenate([np.arange(s, s + n, MOST_WINDOWS) for s, n in zip(starts, sizes)])
        starts, sizes = cuts, np.diff(np.append(cuts, count))
    value = least[starts]
    if np.count_nonzero(np.isin(hashes, value)) == len(np.unique(value)):
        return starts, sizes, value, np.zeros(len(starts), bool)
    reach = sizes + span - 1
    firsts = np.cumsum(reach) - reach
    places = np.arange(reach.sum()) + np.repeat(starts - firsts, reach)
    twice = np.add.reduceat((hashes[places] == np.repeat(value, reach)).astype(np.int64), firsts) > 1
    return starts, sizes, value, twice


def _runs(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = hashlib.blake2b
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        digests: list[bytes] = []

        def told() -> pd.DataFrame:
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            k1, k2, starts, sizes, value, twice = (np.concatenate(c) for c in columns)
            for c in columns:
                c.clear()
            digests.clear()
            return pd.DataFrame({"k1": k1, "k2": k2, "place": starts << 12 | sizes, "v": value, "s1": halves[:, 0], "s2": halves[:, 1], "twice": twice})

        for batch in batches:
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"]):
                for low in range(0, len(text) - length + 1, WINDOWS_AT_ONCE):
                    part = text if len(text) < WINDOWS_AT_ONCE else text[low : low + WINDOWS_AT_ONCE + length - 1]
                    starts, sizes, value, twice = runs(part, length, gram)
                    digests += [digest(part[a : a + n + length - 1], digest_size=16).digest() for a, n in zip(starts.tolist(), sizes.tolist())]
                    for column, x in zip(columns, (np.full(len(starts), k1), np.full(len(starts), k2), starts + low, sizes, value.view(np.int64), twice)):
                        column.append(x)
                    if len(digests) > 20_000:
                        yield told()
        if digests:
            yield told()

    return run


def _pieces(length: int):
    columns = ["shard", "v", "s1", "s2", "times", "parts", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for text, own in zip(batch["text"], batch["own"]):
                for r in own:
                    at = r["place"] >> 12
                    piece = text[at : at + (r["place"] & 0xFFF) + length - 1]
                    rows.append((r["shard"], r["v"], r["s1"], r["s2"], r["times"], r["parts"], piece))
                    held += len(piece)
                if held > 4 << 20:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return run


def shard_repeats(shard: pd.DataFrame, length: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Repeated windows of the shard's runs (of those seen once), and sorted digests of the windows of spread runs."""
    pieces = shard["piece"].tolist()
    owner, offset, classes = suffix_array.repeated_classes(pieces, length)
    times = np.bincount(classes, weights=shard["times"].to_numpy()[owner], minlength=1)
    hit = times[classes] > 1 if len(classes) else np.empty(0, bool)
    once = (shard["times"].to_numpy() == 1)[owner]
    found = pd.DataFrame({"row": owner[hit & once], "low": offset[hit & once]}).sort_values(["row", "low"])
    row, low = found["row"].to_numpy(), found["low"].to_numpy()
    first = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(low) != 1)]) if len(row) else np.empty(0, bool)
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(row)))
    s1, s2 = shard["s1"].to_numpy(), shard["s2"].to_numpy()
    spans = pd.DataFrame({"s1": s1[row[starts]], "s2": s2[row[starts]], "low": low[starts], "high": low[starts] + counts})
    return spans, spread_windows(shard, pieces, owner, offset, classes, length)


def window_digests(words: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of the ``length`` bytes from each place, by rows."""
    out = np.empty((len(places), 2), np.uint64)
    for low in range(0, len(places), 1 << 16):
        at = places[low : low + (1 << 16)]
        one, two = np.full(len(at), MIX[0]), np.full(len(at), MIX[1])
        for i in [*range(0, length - 8, 8), length - 8]:
            word = words[at + i]
            one = (one ^ word) * MIX[1]
            one ^= one >> np.uint64(31)
            two = (two + word) * MIX[2]
            two ^= two >> np.uint64(28)
        out[low : low + len(at), 0], out[low : low + len(at), 1] = one, two
    return out


def spread_windows(shard: pd.DataFrame, pieces: list[bytes], owner: np.ndarray, offset: np.ndarray, classes: np.ndarray, length: int) -> pd.DataFrame:
    """Digests of the windows of spread runs in order; one window of each class stands for the shard in the merge."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(lengths) - lengths
    mine = shard["parts"].to_numpy() > 1
    if not mine.any():
        return pd.DataFrame({"d1": [], "d2": [], "s1": [], "s2": [], "low": []})
    left = np.repeat(starts + lengths, lengths) - np.arange(lengths.sum())
    wanted = (left >= length) & np.repeat(mine, lengths)
    there = starts[owner] + offset
    later = np.ones(len(classes), bool)
    later[np.unique(classes, return_index=True)[1]] = False
    wanted[there[later]] = False
    places = np.flatnonzero(wanted)
    its = np.repeat(np.arange(len(pieces)), lengths)[places]
    digests = window_digests(suffix_array.words_at(np.frombuffer(b"".join(pieces), np.uint8)), places, length)
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    its, places, digests = its[order], places[order], digests[order]
    return pd.DataFrame({"d1": digests[:, 0], "d2": digests[:, 1], "s1": shard["s1"].to_numpy()[its], "s2": shard["s2"].to_numpy()[its], "low": places - starts[its]})


def _shards(length: int, slices: int):
    """Settled spans, whose slice is below zero, and sorted digests of a shard's spread runs, cut into slices by binary
    search, for the merge."""
    columns = ["slice", "s1", "s2", "low", "high", "run", "refs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in (own for several in by_group(batches, "shard") for _, own in several.groupby("shard")):
            shard = shard.reset_index(drop=True)
            spans, merge = shard_repeats(shard, length)
            if len(spans):
                yield spans.assign(slice=-1 - int(shard["shard"].iloc[0]), run=None, refs=None)[columns]
            if not len(merge):
                continue
            heads = (merge["d1"].to_numpy() >> np.uint64(48)).astype(np.int64)
            cuts = np.searchsorted(heads * slices >> 16, np.arange(slices + 1))
            rows = [(i, 0, 0, 0, 0, merge[["d1", "d2"]].iloc[a:b].to_numpy(np.uint64).tobytes(), merge[["s1", "s2", "low"]].iloc[a:b].to_numpy(np.int64).tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pd.DataFrame(rows, columns=columns)

    return run


def merged_repeats(runs_of_slice: pd.DataFrame) -> pd.DataFrame:
    """Windows whose digest another shard has too; each sorted run is looked up in all by binary search. A shard tells a
    window once, so a digest that stands twice comes from two shards."""
    own = [np.frombuffer(r, np.uint64).reshape(-1, 2) for r in runs_of_slice["run"]]
    everything = np.concatenate(own)
    everything = everything[np.lexsort((everything[:, 1], everything[:, 0]))]
    again = (everything[1:] == everything[:-1]).all(axis=1)
    twice = np.unique(everything[1:][again], axis=0)
    found = []
    for digests, refs in zip(own, runs_of_slice["refs"]):
        low, high = (np.searchsorted(twice[:, 0], digests[:, 0], side) for side in ("left", "right"))
        hit = np.zeros(len(digests), bool)
        for step in range(int((high - low).max(initial=0))):
            at = np.minimum(low + step, len(twice) - 1)
            hit |= (low + step < high) & (twice[at, 1] == digests[:, 1])
        found.append(np.frombuffer(refs, np.int64).reshape(-1, 3)[hit])
    rows = np.concatenate(found)
    return pd.DataFrame({"s1": rows[:, 0], "s2": rows[:, 1], "low": rows[:, 2], "high": rows[:, 2] + 1})


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for several in by_group(batches, "slice"):
        settled = several["slice"].to_numpy() < 0
        yield several.loc[settled, ["s1", "s2", "low", "high"]]
        for _, own in several[~settled].groupby("slice"):
            yield merged_repeats(own)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows k1, k2, spans: for each row that ``docs(k1, k2, text)`` has, byte ranges [low, high) that repeat.

    Joins with texts are hinted to go by sorted keys, so that the plan is one at every size, and the texts that
    ``docs`` is dealt out for here are those that the caller joins with the spans (one exchange, used twice).
    """
    long = docs.where(F.octet_length("text") >= length)
    every, drop_every = stored(long.mapInPandas(_runs(length, gram), "k1 long, k2 long, place long, v long, s1 long, s2 long, twice boolean"))
    # of a hash with very many runs the larger side of a join is split, if the other is a table of its own
    common, drop_common = stored(every.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t")).where("n > 1 OR t").select("v"))
    candidates, _ = stored(every.join(common.hint("merge"), "v", "left_semi"))
    drop_every()
    drop_common()
    windows = F.col("place").bitwiseAND(F.lit(0xFFF))
    kinds = candidates.groupBy("v", "s1", "s2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "place")).alias("one"), F.max("twice").alias("twice"))
    kinds = kinds.select("v", "s1", "s2", "times", "twice", "one.*")
    by_hash = kinds.groupBy("v").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("any"), F.sum(windows + (length - 1)).alias("bytes"), F.min("times").alias("least")).where("(kinds > 1 OR any) AND least = 1")
    # where all runs of a hash stand twice they are settled as wholes
    parts = F.ceil(F.col("bytes") / float(shard_bytes)).cast("int")
    mixed, drop_mixed = stored(by_hash.select("v", parts.alias("parts")))
    open_, _ = stored(kinds.join(mixed.hint("merge"), "v").drop("twice"))
    drop_mixed()
    total, spread = open_.agg(F.sum(windows + (length - 1)), F.sum(F.when(F.col("parts") > 1, windows))).first()
    shards, slices = max(1, -(-(total or 0) // shard_bytes)), min(1 << 16, -(-(spread or 0) * 36 // shard_bytes))
    shard = F.pmod(F.xxhash64("v", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("s1"), F.col("parts"))).otherwise(0)), F.lit(shards)).cast("int")
    wanted = open_.withColumn("shard", shard).groupBy("k1", "k2").agg(F.collect_list(F.struct("shard", "v", "s1", "s2", "times", "parts", "place")).alias("own"))
    # repeated rows have equal keys and texts: what they give is counted as repeated anyway
    pieces = docs.join(wanted.hint("merge"), ["k1", "k2"]).select("text", "own").mapInPandas(_pieces(length), "shard int, v long, s1 long, s2 long, times long, parts int, piece binary")
    told = pieces.repartition("shard").sortWithinPartitions("shard").mapInPandas(_shards(length, slices), "slice long, s1 long, s2 long, low long, high long, run binary, refs binary")
    spans = told.repartition("slice").sortWithinPartitions("slice").mapInPandas(_merged, "s1 long, s2 long, low long, high long")
    whole = candidates.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.max(windows).alias("high")).where("n > 1").select("s1", "s2", F.lit(0).cast("long").alias("low"), "high")
    found = candidates.select("k1", "k2", "place", "s1", "s2").join(whole.unionByName(spans), ["s1", "s2"])
    start = F.shiftright("place", 12)
    return found.groupBy("k1", "k2").agg(F.collect_list(F.struct((start + F.col("low")).alias("low"), (start + F.col("high") + (length - 1)).alias("high"))).alias("spans"))


def union(spans: list) -> list[tuple[int, int]]:
    """Maximal ranges that the spans cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def kept_bytes(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in removed for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch["text"], batch["spans"]):
            removed = [] if spans is None else union(spans)
            rows.append((len(text), sum(b - a for a, b in removed), len(removed), hashlib.sha256(kept_bytes(text, removed)).hexdigest()))
        yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])], axis=1)


def keyed(docs: DataFrame) -> DataFrame:
    """Texts with the key of their row, its id and a hash: rows with the same key are equal."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.encode(whole_text(), "UTF-8").alias("text")).select("k1", F.xxhash64("text").alias("k2"), "text")


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; rows repeated are copies of each other; bytes are judged on the input; matches do not cross
    rows but may overlap within one; other columns are ignored.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, length, gram, shard_bytes)
    own = F.when(F.col("k1") != NO_ID, F.col("k1")).alias("doc_id")
    return rows.join(spans.hint("merge"), ["k1", "k2"], "left").select(own, "text", "spans").mapInPandas(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
