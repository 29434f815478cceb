import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from adjudica.llm import edit_counts as E, units

ENCODER = units.UnitEncoder(units.vocabulary_path())


def plain(text, edits):
    for position, deleted, inserted in edits:
        position = min(max(0, position), len(text))
        deleted = min(max(0, deleted), len(text) - position)
        text = text[:position] + inserted + text[position + deleted :]
    return text, len(ENCODER.tokenizer.encode(text, add_special_tokens=False).ids)


ALPHABET = "ab' .\n\té<|"
EDITS = st.lists(st.tuples(st.integers(-2, 400), st.integers(-1, 90), st.text(alphabet=ALPHABET, max_size=30)), max_size=5)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=ALPHABET, max_size=300), EDITS), min_size=1, max_size=4), st.sampled_from([1, 5, 40]))
def test_counts_as_by_encoding_again(docs, run):
    got = E.count_batch(ENCODER, [t for t, _ in docs], [e for _, e in docs], run)
    for (text, edits), (n_chars, n_tokens, n_edits, after, tokens_after, _, changed) in zip(docs, got):
        new, tokens = plain(text, edits)
        assert (n_chars, n_tokens, n_edits) == (len(text), plain(text, [])[1], len(edits))
        assert (after, tokens_after, changed) == (len(new), tokens, new)


def test_edits_touch_little():
    text = "some words of a long text, " * 4000
    (row,) = E.count_batch(ENCODER, [text], [[(50_000, 3, "new"), (0, 1, ""), (len(text), 0, " end")]])
    assert row[5] < 4 * 3 * E.RUN


def test_operator(spark):
    docs = [(1, "one two three", [(4, 3, "2")], "x"), (2, None, [(0, 0, "now text")], "x"), (3, "", None, "x"), (None, "a b", [], None), (1, "one two three", [(4, 3, "2")], "x"), (4, "w" * 100_000, [(50_000, 1, " ")], None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, edits array<struct<position:long,deleted:long,inserted:string>>, n_tokens string")
    got = E.count_edited(df).collect()
    assert len(got) == len(docs)
    for doc_id, text, edits, _ in docs:
        new, tokens = plain(text or "", edits or [])
        assert any((r.doc_id, r.n_tokens_after, r.n_chars_after, r.text_crc32_after) == (doc_id, tokens, len(new), zlib.crc32(new.encode())) for r in got)
    assert E.count_edited(df.limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=600), st.lists(EDITS, min_size=2, max_size=4), st.sampled_from([3, 20]))
def test_rounds_of_edits_from_kept_sums(text, rounds, run):
    """Each round starts from the leaves' sums that the one before it left."""
    (tree,) = E.trees_of(ENCODER, [text], run)
    for edits in rounds:
        held = tree.sums()
        tree = E.CountTree.of(tree.text(), held["chars"], held["tokens"])
        E.edit_batch(ENCODER, [tree], [edits], run)
        text, tokens = plain(text, edits)
        assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), tokens)


def test_what_outgrows_a_leaf_is_cut():
    """After a long insertion, an edit within it encodes a few leaves only."""
    (tree,) = E.trees_of(ENCODER, ["some words here " * 50])
    first = E.edit_batch(ENCODER, [tree], [[(100, 0, "more and more " * 3000)]])
    again = E.edit_batch(ENCODER, [tree], [[(20_000, 2, "x")]])
    assert first[0] > 40_000 and again[0] < 4 * E.RUN
    assert tree.n_tokens == plain(tree.text(), [])[1] and max(tree.sums()["chars"]) < 4 * E.RUN


def test_second_round_reads_no_untouched_text(spark, monkeypatch):
    """Trees come back as a column; what a second round encodes is what its edits touch."""
    text = "some words of a long text, " * 3000
    schema = "doc_id long, text string, edits array<struct<position:long,deleted:long,inserted:string>>"
    df = spark.createDataFrame([(1, text, [(500, 3, "new")]), (None, None, [(0, 0, "a b")]), (2, "", None)], schema)
    once = E.apply_edits(E.with_trees(df))
    edits = F.array(F.struct(F.lit(40_000).cast("long").alias("position"), F.lit(1).cast("long").alias("deleted"), F.lit("z").alias("inserted")))
    twice = {r.doc_id: r for r in E.apply_edits(once.withColumn("edits", edits)).collect()}
    new, tokens = plain(text, [(500, 3, "new"), (40_000, 1, "z")])
    assert (twice[1].text, twice[1].n_tokens_after) == (new, tokens) and twice[1].encoded_chars < 3 * E.RUN
    assert twice[None].text == plain("a b", [(40_000, 1, "z")])[0]
    stale = once.withColumn("edits", edits).withColumn("text", F.lit("other"))
    with pytest.raises(Exception, match="not of its text"):
        E.apply_edits(stale).collect()
