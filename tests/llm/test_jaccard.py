import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from adjudica.llm import jaccard as J

SCHEMA = "doc_id long, text string, sig string, root string"


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """The smallest id of each group, by the Jaccard similarity of all pairs."""
    sets, parent = [plain_set(t) for _, t, *_ in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    groups = {}
    for i, (doc_id, *_) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values())


def corpus():
    """Texts and copies with edits around the similarity of 0.8, and many that share a passage."""
    rng, rows = random.Random(4), []
    words = [f"w{i}" for i in range(900)]
    passage = [rng.choice(words) for _ in range(60)]
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([2, 5, 40, 150, 400]))]
        text = text[:20] + passage + text[20:] if i % 4 == 0 else text
        rows.append((100 * i, " ".join(text)))
        for k in range(rng.choice([0, 1, 3])):
            other = list(text)
            for _ in range(round(len(text) * rng.uniform(0, 0.04))):
                other[rng.randrange(len(other))] = "edited"
            rows.append((100 * i + 1 + k, " ".join(other).upper() + "\n"))
    base = [rng.choice(words) for _ in range(200)]  # a large group, whose members are not all alike
    for i in range(80):
        other = list(base)
        for _ in range(rng.choice([1, 3, 5])):
            other[rng.randrange(200)] = f"e{rng.randrange(900)}"
        rows.append((50_000 + i, " ".join(other)))
    rows += [(90_000 + i, t) for i, t in enumerate([None, "", " \n", "a b c", "A  b c", "a b d"])]
    rng.shuffle(rows)
    return [(d, t, "clash", None) for d, t in rows]


def test_against_all_pairs(spark):
    rows = corpus()
    want, df = plain_kept(rows), spark.createDataFrame(rows, SCHEMA)
    stage = C.deduplicate(spark, df, "")
    assert stage.columns == ["doc_id", "text", "sig", "root"]
    assert sorted(r.doc_id for r in stage.collect()) == want
    assert sorted(r.doc_id for r in J.keep_one(df, block=16).collect()) == want  # components of several blocks


def test_large_groups_are_joined_in_rounds(spark):
    """Many near copies of one text, some of them out of reach of most others; and a chain of small steps."""
    rng = random.Random(11)
    words, rows = [f"w{i}" for i in range(500)], []
    base = [rng.choice(words) for _ in range(160)]
    for i in range(150):
        other = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            other[rng.randrange(160)] = f"e{rng.randrange(500)}"
        rows.append((i, " ".join(other), None, None))
    step = list(base)
    for i in range(60):
        step[i * 2 + 20] = f"s{i}"
        rows.append((1000 + i, " ".join(step), None, None))
    rng.shuffle(rows)
    want = plain_kept(rows)
    for block in (8, 40):
        assert sorted(r.doc_id for r in J.keep_one(spark.createDataFrame(rows, SCHEMA), block=block).collect()) == want


def test_blocks_of_one_part_do_not_meet(spark):
    """Of 300 classes of one part and 3 others, only pairs of blocks with another part are dealt, and the component at
    once; where bands are small, band by band."""
    keyed = [(9, 1, i) for i in range(303)] + [(9, 2, 5), (9, 2, 6)] + [(9, 3, i) for i in range(1, 303)]
    keyed += [(8, 1000 + i, 5000 + i + k) for i in range(200) for k in (0, 1)] + [(8, 2000 + i, 5000 + i + k) for i in range(200) for k in (0, 1)]
    parts = [(i, 0 if i < 300 else i) for i in range(303)] + [(5000 + i, 5000 + i) for i in range(201)]
    keyed = spark.createDataFrame(keyed, "root long, key long, sig long").groupBy("root", "sig").agg(F.collect_list("key").alias("keys"))
    rows = J.left_over(keyed, spark.createDataFrame(parts, "sig long, part long"), 50).collect()
    places = {}
    for r in rows:
        places.setdefault(r.place, []).append(r)
    large = [own for own in places.values() if own[0].sig < 5000]
    assert len(large) == 7  # six blocks of the part with the shared one, and that one alone
    assert all(any(r.part >= 300 for r in own) for own in large)
    met = {(a.sig, b.sig) for own in places.values() for a in own for b in own}
    assert {(i, j) for i in range(303) for j in range(300, 303)} <= met
    assert len(places) == 207 and {(5000 + i, 5001 + i) for i in range(200)} <= met  # equal bands once


def test_empty(spark):
    assert J.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f"), (4, "a b c d e f"), (None, "alone words of nobody at all"), (7, ""), (7, "other text with id seven")]
    kept = J.keep_one(spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in kept) == [("4", "a b c d e f"), ("7", ""), ("7", "other text with id seven"), ("None", "alone words of nobody at all")]


def test_near_fingerprints_without_a_shared_band_in_components_of_any_size(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(3000)]
    rows = [(i, " ".join([*base[: 100 * i], "other", *base[100 * i + 1 :]])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = df.select(F.col("doc_id").alias("least"), J.sketch(F.col("text"), 5, False).alias("s")).select("least", "s.sig", "s.fp")
    own = J.materialize(made.withColumn("keys", F.array(*[F.xxhash64("sig", F.lit(k)) for k in range(J.BANDS)])), "own")  # no band is shared
    for block in (512, 2):
        linked = J.with_roots(J.verified(df, "doc_id", "text", own, 5, (4, 5), 5, block, False)).collect()
        assert len({r.sig for r in linked}) == 6 and len({r.root for r in linked}) == 1, block
