"""SimHash near-duplicates held to an exact Jaccard similarity of word shingles: ``SIMILARITY`` or more links two texts.

1. A text is the set of its shingles of five words (64-bit hashes; case of ASCII letters and white space don't count, a
   shorter text is one shingle). Equal sets form one class, which is all that goes on.
2. Classes whose SimHash fingerprints differ in at most 5 bits are candidates, found by the vantage-point trees of
   ``simhash``. At a similarity of 0.8 fingerprints differ in about 10 bits, where the trees no longer prune, so the
   rest comes by another exact way: classes that agree in one of 48 bands of 6 minimum hashes are candidates too. A
   pair of similarity s shares no band with probability (1 - s**6)**48: 5e-7 at 0.8, less above.
3. Candidates grow together to components, which only bound what is compared. Components of up to 512 classes are
   compared whole, many to a task: each pair that is near by its fingerprint or shares a band, and isn't linked yet, by
   its whole sets; only pairs that reach the similarity become links.
4. In larger components, first each class is compared with one other that shares a band or its fingerprint, the smallest
   of the largest part so far, in two rounds over half of the bands each, and what is linked grows together. That joins a group of any number
   of near copies at one comparison a copy. Only bands that still hold classes of several parts go on: their classes
   meet in blocks of 512, a block of one part only with blocks of others, band by band or a component at once, so that
   still every pair which shares a band is compared or linked by way of others, and no task holds more than two blocks.
   So do classes of several parts that agree in three of the eight bytes of their fingerprints, which holds every pair
   within 5 bits: the pairs that are compared don't depend on a component's size.
5. Groups grow together from the links as they do for fingerprints.

Null and empty texts are one class. A null doc_id is never the smallest of a group, unless all are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.llm.common import give_back, leave_out, materialize, scratch
from adjudica.llm.simhash import LOWER, components, tree_links

WORDS, SIMILARITY = 5, (4, 5)  # similarity as a fraction, so that the comparison is exact
BITS = 5  # the widest radius at which three blocks of a fingerprint still differ in one bit at most
BANDS, ROWS, SEED = 48, 6, 42
BLOCK = 512  # classes that go to one block
ROUNDS = 2  # of comparing each class of a large component with one other
CHUNK = 1 << 8
FACTORS = np.random.default_rng(SEED).integers(1 << 32, size=(2, BANDS * ROWS), dtype=np.uint32) | np.array([[1], [0]], np.uint32)
PRIME = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(SEED).integers(1 << 64, size=256, dtype=np.uint64)
SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word: a polynomial in random numbers that stand for its bytes."""
    raw = np.frombuffer((text or "").encode().translate(LOWER), np.uint8)
    used = np.flatnonzero(~SPACE[raw])
    if not len(used):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(used, prepend=-2) > 1)
    sizes = np.diff(np.append(first, len(used)))
    powers = np.cumprod(np.full(sizes.max(), PRIME))
    return mixed(np.add.reduceat(BYTES[raw[used]] * powers[np.arange(len(used)) - np.repeat(first, sizes)], first))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    each = word_hashes(text)
    words = min(words, len(each))
    out = np.full(len(each) - words + 1, words, np.uint64)
    for k in range(words):
        out = out * PRIME + each[k : k + len(out)]
    return np.unique(mixed(out))


def bands(own: np.ndarray) -> np.ndarray:
    """One key a band; texts with equal minimum hashes in a band have equal keys."""
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    some = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(some), CHUNK):
        least = np.minimum(least, (some[at : at + CHUNK, None] * FACTORS[0] + FACTORS[1]).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mixed(out * PRIME + column)
    return out.view(np.int64)


def fingerprint_of(own: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), CHUNK * 64):
        ones += np.unpackbits(own[at : at + CHUNK * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0])


def sketch(text: Column, words: int, whole: bool) -> Column:
    """(sig, fp, keys) of a text, and where ``whole`` its set too."""
    fields = ["sig long", "fp long", "keys array<long>", "own binary"][: 3 + whole]

    @F.arrow_udf(", ".join(fields))
    def made(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        sets = [shingles(t.as_py(), words) for t in texts]
        keys = np.concatenate([np.zeros(0, np.int64), *map(bands, sets)])
        sigs = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        fps = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
        out = [pa.array(sigs), pa.array(fps), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))]
        out += [pa.array([s.tobytes() for s in sets], pa.binary())] * whole
        del sets
        give_back()
        return pa.StructArray.from_arrays(out, [f.split()[0] for f in fields])

    return made.asNondeterministic()(text) if whole else made(text)  # so that no filter on it moves below a join


def similar(one: np.ndarray, others: list[np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """Which of the others reach the similarity to this one."""
    sizes = np.array([len(o) for o in others], np.int64)
    joined = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined
    common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return common * similarity[1] >= (len(one) + sizes - common) * similarity[0]


def linker(similarity: tuple[int, int], bits: int):
    """The links of one pair of blocks, or of some whole components: a spanning star per group. Rows of equal ``part``
    are linked already, and only rows of different blocks meet where a group holds two."""
    up, down = similarity

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        sigs, fps, block, n = rows["sig"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["block"].to_numpy(), len(rows)
        sets = [np.frombuffer(o, np.uint64) for o in rows["own"]]
        sizes, keys = np.array([len(s) for s in sets]), np.stack(rows["keys"].to_numpy())
        across = block.min() != block.max()  # pairs within a block meet where it is paired with itself
        part = np.unique(rows["part"].to_numpy(), return_inverse=True)[1]
        label, tested = part.copy(), np.zeros((n, n), bool)

        def compare(one: int, others: np.ndarray) -> None:
            others = others[(label[others] != label[one]) & ~tested[one, others]]
            others = others[np.minimum(sizes[others], sizes[one]) * down >= np.maximum(sizes[others], sizes[one]) * up]
            others = others[block[others] != block[one]] if across else others
            if len(others):
                tested[one, others] = tested[others, one] = True
                near = others[similar(sets[one], [sets[o] for o in others], similarity)]
                label[np.isin(label, label[near])] = label[one]

        for one in range(n - 1):
            others = one + 1 + np.flatnonzero(np.bitwise_count(fps[one + 1 :] ^ fps[one]) <= bits)
            if len(others):
                compare(one, others)
        for column in keys.T:
            order = np.argsort(column, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(column[order])) + 1):
                for at in range(len(run) - 1):
                    compare(run[at], run[at + 1 :])
        one_each = np.unique(part, return_index=True)[1]  # of what was linked before, one row speaks for all
        sigs, label = sigs[one_each], label[one_each]
        first = pd.Series(sigs).groupby(label).transform("min").to_numpy()
        return pd.DataFrame({"a": first, "b": sigs})[first != sigs]

    return links


def with_roots(links: DataFrame) -> DataFrame:
    """(sig, root) of every linked class, the root's own row included."""
    found = components(links).select(F.col("b").alias("sig"), F.col("a").alias("root"))
    return found.union(found.select(F.col("root").alias("sig"), "root").distinct())


def stars(each: DataFrame, key: str) -> DataFrame:
    """Links from the smallest class that has a key to all others that have it."""
    shared = materialize(each.groupBy(key).agg(F.min("sig").alias("a"), F.max("sig").alias("most")).filter("a < most").select(key, "a"), "shared")
    return each.join(shared, key).filter("sig > a").select("a", F.col("sig").alias("b"))


def candidates(own: DataFrame, bits: int) -> DataFrame:
    """Links that connect all classes with near fingerprints, and all that share a band."""
    first = materialize(own.groupBy("fp").agg(F.min("sig").alias("sig")), "fingerprints")
    near = tree_links(first.select("fp"), bits)
    one, other = first.toDF("a", "one"), first.toDF("b", "other")
    near = near.join(one, "a").join(other, "b").select(F.col("one").alias("a"), F.col("other").alias("b"))
    banded = stars(own.select("sig", F.explode("keys").alias("key")), "key")
    return near.union(stars(own.select("sig", "fp"), "fp")).union(banded)


def compared(similarity: tuple[int, int], pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of some pairs (a, b) of classes that reach the similarity."""
    up, down = similarity

    @F.arrow_udf("boolean")
    def reach(one: pa.Array, other: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(one, other, strict=True):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            able = min(len(a), len(b)) * down >= max(len(a), len(b)) * up
            out.append(bool(able and similar(a, [b], similarity)[0]))
        return pa.array(out, pa.bool_())

    pivots = materialize(sets.join(pairs.select(F.col("a").alias("sig")).distinct(), "sig").select(F.col("sig").alias("a"), F.col("own").alias("one")), "pivots")
    met = pairs.join(sets.select(F.col("sig").alias("b"), F.col("own").alias("other")), "b").join(pivots, "a")
    return met.filter(reach("one", "other")).select("a", "b")


def parts_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, part) of all nodes, a part being what the links join."""
    found = components(links).select(F.col("b").alias("sig"), F.col("a").alias("root"))
    return materialize(nodes.select("sig").join(found, "sig", "left").select("sig", F.coalesce("root", "sig").alias("part")), "parts")


def near_keys(fp: Column, bits: int) -> Column:
    """Keys of which two fingerprints share one at least if they differ in ``bits`` bits or fewer: as many bits leave
    all but that many of the eight bytes equal."""
    kept = combinations(range(8), max(0, 8 - bits))
    masks = np.array([sum(255 << 8 * at for at in some) for some in kept], np.uint64).view(np.int64).tolist()
    return F.array(*[F.xxhash64(fp.bitwiseAND(F.lit(m).cast("long")), F.lit(nth + 1)) for nth, m in enumerate(masks)])


def of_round(nth: int):
    return lambda key: F.pmod(key, F.lit(ROUNDS)) == nth


def in_rounds(keyed: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Links of large components by one comparison a class and round, each round over a part of the keys, and the parts
    that they make. ``keyed``: (root, sig, keys, near) of classes that share keys; ``near`` only counts in ``left_over``."""
    nodes = keyed.select("sig")
    parts, links, tested = nodes.withColumn("part", F.col("sig")), None, None
    for nth in range(ROUNDS):
        with scratch(keyed.sparkSession) as keep:
            own = F.filter("keys", of_round(nth))
            each = materialize(keyed.join(parts, "sig").select("sig", "part", F.explode(own).alias("key")), "round")
            sizes = each.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("sig").alias("a"))
            pivots = sizes.groupBy("key").agg(F.max(F.struct("n", F.bitwise_not("part").alias("neg"), "a")).alias("most"), F.count("*").alias("n_parts")).filter("n_parts > 1").select("key", "most")
            met = each.join(pivots, "key").filter(F.col("part") != F.bitwise_not(F.col("most.neg")))
            wanted = met.select(F.col("most.n").alias("n"), F.col("most.a").alias("a"), F.col("sig").alias("b"))
            if tested is not None:
                wanted = wanted.join(tested, ["a", "b"], "left_anti")
            pairs = materialize(wanted.groupBy("b").agg(F.max(F.struct("n", F.bitwise_not("a").alias("neg"))).alias("m")).select(F.bitwise_not(F.col("m.neg")).alias("a"), "b"), "pairs")
            if not pairs.limit(1).count():
                continue
            good = compared(similarity, pairs, sets)
            links = keep(materialize(good if links is None else links.union(good), "star-links"))
            tested = keep(materialize(pairs if tested is None else tested.union(pairs), "tested"))
            parts = keep(parts_of(nodes, links))
    return links, parts


def left_over(keyed: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """(sig, part, block, place): the classes of bands that still hold several parts, dealt to pairs of blocks. Of a
    component either each such band is dealt (those that hold the same classes once) or all its classes in such bands
    together, whichever moves fewer rows: the first where bands are small, the second where most classes are one part.
    ``keyed``: (root, sig, keys, near). A part with more than a block's worth has blocks of its own, which don't meet each
    other; the others share blocks."""
    each = keyed.join(parts, "sig").select("root", "sig", "part", F.explode(F.concat("keys", "near")).alias("key"))
    sums = each.groupBy("root", "key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("h"))
    keys = sums.filter("low < high").groupBy("root", "n", "h").agg(F.min("key").alias("key")).select("root", "key")
    open_ = materialize(each.join(keys, ["root", "key"]), "open")
    together = open_.select("root", F.col("root").alias("key"), "sig", "part").distinct()

    def sized(rows: DataFrame) -> DataFrame:
        """(root, key, part, own, blocks, cost) of the parts of each key."""
        n = rows.groupBy("root", "key", "part").agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") > block, F.col("part")))
        shared = n.groupBy("root", "key").agg(F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(0)).alias("shared"), F.sum(F.when(F.col("own").isNotNull(), F.ceil(F.col("n") / block)).otherwise(0)).alias("own_blocks"))
        n = n.join(shared, ["root", "key"]).withColumn("blocks", F.ceil(F.when(F.col("own").isNull(), F.col("shared")).otherwise(F.col("n")) / block))
        met = F.col("own_blocks") + F.ceil(F.col("shared") / block) - F.when(F.col("own").isNotNull(), F.col("blocks")).otherwise(0)
        return materialize(n.select("root", "key", "part", "own", "blocks", (F.col("n") * met).alias("cost")), "part-sizes")

    by_key, by_root = sized(open_), sized(together)
    cost = by_root.groupBy("root").agg(F.sum("cost").alias("whole")).join(by_key.groupBy("root").agg(F.sum("cost").alias("split")), "root")
    choice = materialize(cost.select("root", (F.col("whole") <= F.col("split")).alias("whole")), "choice")

    def dealt(rows: DataFrame, sizes: DataFrame, whole: bool) -> DataFrame:
        wanted = choice.filter(F.col("whole") if whole else ~F.col("whole")).select("root")
        found = rows.join(wanted, "root", "left_semi").join(sizes.select("root", "key", "part", "own", "blocks"), ["root", "key", "part"])
        nth = F.pmod(F.xxhash64("sig"), F.col("blocks"))
        return found.select("root", "key", "sig", "part", F.xxhash64("own", nth).alias("block"), "own")

    held = materialize(dealt(open_.select("root", "key", "sig", "part"), by_key, False).union(dealt(together, by_root, True)), "left-over")
    ids = held.select("root", "key", "block", "own").distinct()
    pairs = ids.alias("x").join(ids.alias("y"), ["root", "key"]).filter("x.block <= y.block and (x.own is null or y.own is null or x.own <> y.own)")
    pairs = pairs.select("root", "key", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = pairs.select("root", "key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return held.join(sides, ["root", "key", "block"]).select("sig", "part", "block", F.xxhash64("root", "key", "i", "j").alias("place"))


def verified(df: DataFrame, id_col: str, text_col: str, own: DataFrame, words: int, similarity: tuple[int, int], bits: int, block: int, repeated: bool) -> DataFrame:
    """Links (a, b) between candidates of the given similarity."""
    met = materialize(with_roots(candidates(own, bits)), "candidates")
    sizes = met.groupBy("root").agg(F.count("*").alias("n"))
    dealt = materialize(met.join(sizes, "root").join(own, "sig"), "dealt")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = materialize(dealt.select("least").distinct(), "wanted")  # of known size when the join is planned: texts stay in place
    texts = texts.join(wanted, texts["id"].eqNullSafe(wanted["least"]), "left_semi")
    sets = texts.select(sketch(F.col("text"), words, True).alias("s")).select("s.*")
    sets = materialize(sets.dropDuplicates(["sig"]) if repeated else sets, "sets")
    groups = max(1, met.count() // block)
    columns = ["sig", "fp", "keys", "own", "part", "block", "place"]
    small = dealt.filter(F.col("n") <= block).select("sig", F.col("sig").alias("part"), F.lit(0).cast("long").alias("block"), F.pmod(F.xxhash64("root"), F.lit(groups)).alias("place"))
    links = sets.join(small, "sig").select(columns).groupBy("place").applyInPandas(linker(similarity, bits), "a long, b long")
    large = dealt.filter(F.col("n") > block)
    if not large.limit(1).count():
        return links
    own_keys = F.concat("keys", F.array(F.xxhash64("fp", F.lit(0))))
    every = large.select("root", "sig", F.posexplode(F.concat(own_keys, near_keys(F.col("fp"), bits))).alias("at", "key"))
    shared = materialize(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "large-keys")
    of = lambda which: F.collect_list(F.when(which, F.col("key")))  # noqa: E731  a class has BANDS + 1 and 70 at most
    keyed = every.join(shared, "key").groupBy("root", "sig").agg(of(F.col("at") <= BANDS).alias("keys"), of(F.col("at") > BANDS).alias("near"))
    keyed = materialize(keyed, "keyed")
    own_sets = materialize(sets.join(large.select("sig"), "sig"), "large-sets")
    stars, parts = in_rounds(keyed, own_sets, similarity)
    rest = left_over(keyed, parts, block)
    more = own_sets.join(rest, "sig").select(columns).groupBy("place").applyInPandas(linker(similarity, bits), "a long, b long")
    return links.union(more) if stars is None else links.union(more).union(stars)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The document with the smallest id of every group, with all its columns; among rows with equal ids one."""
    with scratch(df.sparkSession) as keep:
        made = df.select(F.col(id_col).cast("long").alias("doc_id"), sketch(F.col(text_col), words, False).alias("s"))
        made = materialize(made.select("doc_id", "s.*"), "sketches")
        own = materialize(made.groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "classes")
        repeated = made.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count() > 0
        linked = materialize(with_roots(verified(df, id_col, text_col, own, words, similarity, bits, block, repeated)).join(own.select("sig", "least"), "sig"), "linked")
        smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        named = linked.select("sig", "root").join(smallest, "root")
        rest = own.select("sig", "least").join(named, "sig", "left")
        known = keep(materialize(rest.select("sig", F.coalesce("root", "sig").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "components"))
        gone = None if repeated else keep(materialize(made.select("doc_id", "sig").join(known, "sig").filter("doc_id <> component_id").select("doc_id"), "removed"))
    if gone is not None:
        return leave_out(df, id_col, gone)
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), sketch(F.col(text_col), words, False)["sig"].alias("sig"))
    firsts = rows.join(known, "sig").filter(F.col("id").eqNullSafe(F.col("component_id")))
    one = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("row")))).filter("nth = 1")
    return one.select("row.*")
