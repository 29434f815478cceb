import random

import numpy as np
import xxhash

from adjudica.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for text in ("", None, " \n", "One", "a b c", "A b C d e f g É ÀB", "w " * 70_000 + "z"):
        assert S.fingerprint(text) == plain_fingerprint(text)


def near_numbers(rng, n):
    points = {rng.getrandbits(64) for _ in range(n // 3)} | {0}
    for _ in range(n // 60):  # chains and dense balls
        at = rng.getrandbits(64)
        for _ in range(40):
            points.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])))
    return points


def test_group_and_shards_lose_no_link():
    rng = random.Random(5)
    points = np.array(sorted(near_numbers(rng, 4000)), np.uint64)
    want = plain_components([int(p) for p in points])
    label = np.arange(len(points))
    for seed, (mask, radius) in enumerate(S.blocks(4)):
        top = S.Top(points[::7], 4, mask, radius, seed)
        index, shard = top.shards(points)
        assert set(index) == set(range(len(points))) and shard.max() < 16
        for s in np.unique(shard):
            own = np.unique(points[index[shard == s]])
            where = np.searchsorted(points, own)
            got = S.group(own, mask, radius, 4)
            label = S.roots(len(points), where, where[got], label)
    assert label.tolist() == want
    whole = S.group(points, (1 << 64) - 1, 4, 4)
    assert whole.tolist() == want


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.choice([2, 5, 60, 300]))]
        rows.append((10 * i, " ".join(text)))
        for k in range(rng.choice([0, 0, 1, 3])):
            other = list(text)
            other[rng.randrange(len(other))] = "edited"
            rows.append((10 * i + 1 + k, " ".join(other)))
    rows += [(9000 + i, t) for i, t in enumerate(["", None, " ", "same text here now ok"])] + [(9100 + i, "same text here now ok") for i in range(60)]
    return [(d, t, "clash", None) for d, t in rows]


def test_components_against_all_pairs(spark):
    rows = corpus()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    want = plain_components(fps)
    smallest = {}
    for (doc_id, *_), root in zip(rows, want):
        smallest[root] = min(doc_id, smallest.get(root, doc_id))
    linked = S.link(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in linked}
    assert len(linked) == len(rows)
    assert got == {d: (f, smallest[r]) for (d, *_), f, r in zip(rows, fps, want)}
    kept = S.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "root"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest.values())


def test_small_shards_and_long_chains(spark):
    rng = random.Random(8)
    points = sorted(near_numbers(rng, 1200))
    want = plain_components(points)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(points)], "doc_id long, fp long")
    for dense in (8, 1):  # with 1, most shards are dealt to parts
        got = {r.fp & (1 << 64) - 1: r.component_id for r in S.classes(df, shard=64, sample=500, dense=dense).collect()}
        assert [got[p] for p in points] == want


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", None, None), (None, "a b c d e f", None, None), (4, "a b c d e f", None, None), (4, "a b c d e f", None, None), (None, "alone words of nobody at all", None, None), (7, "", None, None), (7, "other text with id seven", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in S.link(df).collect()), key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (None, None), (7, 7), (7, 7)], key=str)
    kept = S.keep_one(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("4", "a b c d e f"), ("7", ""), ("7", "other text with id seven"), ("None", "alone words of nobody at all")]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.link(empty).collect() == [] and S.keep_one(empty).collect() == []
