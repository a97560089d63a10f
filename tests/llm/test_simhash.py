import numpy as np
import pytest

from veridict.llm import golay, simhash


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 4000)
    keys = golay.keys(words)
    assert set((keys >= 0).sum(axis=1)) <= {1, 6}
    for flips in (0, 1, 2):
        other = words.copy()
        for i in range(flips):
            other ^= 1 << ((rng.integers(0, 11, len(words)) * 2 + i) % 23)
        met = ((keys[:, :, None] == golay.keys(other)[:, None, :]) & (keys >= 0)[:, :, None]).any(axis=(1, 2))
        assert met.all()


def test_fuzzy_keys_meet_within_four_bits():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = prints.copy()
    for i in range(len(prints)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    sets = [[set() for _ in prints] for _ in range(2)]
    for found, x in zip(sets, (prints, other)):
        for r, k in zip(*simhash.fuzzy_keys(x)):
            found[r].add(k)
    assert all(a & b for a, b in zip(*sets))


def brute(rows):
    """Fingerprints bit by bit, all pairs, breadth-first components."""
    import xxhash

    prints = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for blank in "\t\n\x0b\x0c\r":
            words = words.replace(blank, " ")
        words = [w for w in words.split(" ") if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    out = {}
    for i in range(len(rows)):
        if i in out:
            continue
        group, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in range(len(rows)):
                if y not in group and (prints[x] ^ prints[y]).bit_count() <= 4:
                    group.add(y)
                    todo.append(y)
        first = min((rows[y][0] for y in group if rows[y][0] is not None), default=None)
        out |= {y: (rows[y][0], f"{prints[y]:016x}", first) for y in group}
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("kind", ["mixed", "hub"])
def test_near_groups_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "a b c d e"), (None, "lonely words of no id at all"), (1006, "x y É")]
    for i in range(160):
        words = base[0 if kind == "hub" else i % len(base)].split()
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [rows[-1]] * 3
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    assert sorted(map(tuple, simhash.near_groups(df).collect()), key=str) == brute(rows)


def test_grown_components_equal_small_ones():
    rng = np.random.default_rng(2)
    x = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    linked = sum(len(a) for a, _ in simhash._grown(x))
    assert linked == len(x) - 1


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
