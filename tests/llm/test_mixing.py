import math

import pytest

from adjudica.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def shared_out(sizes):
    """The targets by rounds: what is above three times its size is cut, the excess is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, opened = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and opened:
        unit = left / sum(weight[s] for s in opened)
        left = 0.0
        for s in sorted(opened, key=str):
            target[s] += unit * weight[s]
        for s in list(opened):
            if target[s] >= 3 * sizes[s] - 1e-12:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                opened.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5, None: 1}, {"a": 7, "b": 7, "c": 7}, {"x": 1, "y": 100000, "z": 0, "é": 50, None: 2000}, {"only": 9}, {"a": 0, None: 0}])
def test_targets_as_by_rounds(spark, sizes):
    rows = [(i, " ".join(["w"] * n) if n else None, s, "clash") for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in mixing.shares(spark.createDataFrame(rows, SCHEMA)).collect()}
    for s, t in shared_out(sizes).items():
        assert got[s] == pytest.approx(t, rel=1e-9, abs=1e-9)


def test_copies_and_edges(spark):
    rows = [(i, "a b c", "s", "x") for i in range(4000)] + [(7, "a b c", "s", "x"), (None, None, None, None), (9, "", None, None)]
    rows += [(10_000 + i, "one two", "t", None) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.shares(df).collect()
    assert len(got) == len(rows) and len({r.copies for r in got if r.doc_id == 7}) == 1
    for source in ("s", "t"):
        own = [r for r in got if r.source == source]
        taken, target = sum(r.size * r.copies for r in own), own[0].target
        rate = target / own[0].source_size
        assert all(r.copies in (math.floor(rate), math.floor(rate) + 1) for r in own) and all(r.copies <= 3 for r in own)
        assert abs(taken - target) < math.sqrt(sum(r.size**2 for r in own)) / 4 + 3
    assert all(r.copies == 0 for r in got if r.source is None)
    emitted = mixing.mix(df)
    assert emitted.columns == df.columns
    want = sorted(r.doc_id for r in got for _ in range(r.copies))
    assert sorted(r.doc_id for r in emitted.collect()) == want
    assert sorted(map(str, mixing.shares(df).collect())) == sorted(map(str, got))


def test_columns_that_clash(spark):
    """Own columns named like anything here stay as they were."""
    names = ["doc_id", "text", "source", "size", "source_size", "target", "copies", "chosen", "row", "name", "nth"]
    rows = [(i, "a b", "s" if i % 2 else "t", *[i * 10 + j for j in range(8)]) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('text', 'source') else 'long'}" for n in names))
    got = mixing.mix(df)
    assert got.columns == names and set(map(tuple, got.collect())) <= set(rows)
    assert mixing.shares(df).count() == 40


def test_many_sources_as_by_sql(spark, tmp_path):
    """Query and SQL agree on null ids, null sources and sources in many ranges."""
    import duckdb

    from adjudica.llm.queries import OP4_SQL, op4_mixing

    rows = [(i if i % 9 else None, "w " * (i * i % 37), f"s{i * 7 % 61:02d}é" if i % 11 else None) for i in range(700)] + [(3, None, "z"), (3, None, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(OP4_SQL).fetchall()
    assert sorted(map(str, map(tuple, op4_mixing(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.shares(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_are_cut_at_ascii_white_space_only(spark):
    df = spark.createDataFrame([("a\tb\x0bc\x1cd e  f\x85",), ("",), (None,), (" \n",)], "text string")
    assert [r[0] for r in df.select(mixing.word_count(df.text)).collect()] == [4, 0, 0, 0]
