import hashlib
import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from adjudica.llm import chat

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "gpt", "content": "yo"}]}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"system": "be", "conversations": [{"from": "human", "value": "q"}]}, "conversations", [("system", "be"), ("user", "q")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": ""}, "instruction", [("user", "do"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c"}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "prompt-response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question-answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"turns": [{"role": "tool", "text": None}]}, "rows", [("tool", "")]),
    ({"messages": []}, "messages", []),
    ({"prompt": "p"}, None, None),
    ({"prompt": "p", "response": "r", "completion": "c"}, None, None),
    ({}, None, None),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"text": "b", "type": "text"}]}, {"role": "gpt", "content": [{"type": "text", "text": "c"}]}]}, "message-parts", [("user", "a\nb"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": [{"text": "only"}]}]}, "message-parts", [("user", "only")]),
    ({"messages": [{"role": "user", "content": [{"type": "image", "url": "x"}, {"type": "text", "text": "a"}]}]}, None, None),
    ({"messages": [{"role": "user", "content": [{"type": "audio", "text": "a"}]}]}, None, None),
    ({"messages": [{"role": "user", "content": ["a", "b"]}]}, None, None),
    ({"messages": [{"role": "user", "content": {"a": 1}}]}, None, None),
    ({"messages": [{"role": "user", "content": "x"}, {"role": "user", "content": [{"text": "y"}]}]}, None, None),
    ({"messages": [{"role": "user", "content": "x", "weight": 1, "name": None}], "meta": {"deep": [1]}}, "messages", [("user", "x")]),
    ({"messages": [{"role": "user", "content": "x", "tool_calls": [{"id": 1}]}]}, None, None),
    ({"messages": "text"}, None, None),
    ({"messages": ["text"]}, None, None),
    ({"prompt": ["p"], "response": "r"}, None, None),
    ({"instruction": "a, b: S>", "output": 3, "input": None}, "instruction", [("user", "a, b: S>"), ("assistant", "3")]),
    ({"prompt": "p", "completion": "c", "messages, prompt": 1, "`": {"x": None}}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r), "clash") for i, (r, *_) in enumerate(RECORDS)] + [(99, None, "x"), (100, "not json", "x")], "n int, record string, layout string")
    got = {r.n: r for r in chat.canonical_turns(df, "record").collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout, RECORDS[i]
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == (turns or (None if turns is None else [])) or turns == []
    assert got[99].layout is None and got[100].turns is None
    assert len({r.fingerprint for r in got.values()}) >= 9


def test_structs_like_json(spark):
    df = spark.sql("SELECT named_struct('messages', array(named_struct('role', 'user', 'content', 'x', 'more', 1))) AS record")
    row = chat.canonical_turns(df, "record").first()
    assert row.layout == "messages" and [tuple(t) for t in row.turns] == [("user", "x")]
    parts = "named_struct('role', 'user', 'content', array(named_struct('type', {0}, 'text', 'x')))"
    for kind, layout, turns in (("'text'", "message-parts", [("user", "x")]), ("string(null)", "message-parts", [("user", "x")]), ("'audio'", None, None)):
        row = chat.canonical_turns(spark.sql(f"SELECT named_struct('messages', array({parts.format(kind)})) AS record"), "record").first()
        assert row.layout == layout and (row.turns and [tuple(t) for t in row.turns]) == turns
    odd = spark.sql("SELECT named_struct('messages', array(named_struct('role', 'user', 'content', array('x')))) AS record")
    assert chat.canonical_turns(odd, "record").first().turns is None
    assert chat.canonical_turns(spark.sql("SELECT named_struct('prompt', array(1), 'response', 'x') AS record"), "record").first().layout is None


def test_fingerprints_follow_the_own_paths(spark):
    """Equal paths in any order give one fingerprint, whatever the values; other paths give another."""
    same = [{"a": 1, "messages": [{"role": "u", "content": "x"}]}, {"messages": [{"content": "longer", "role": "y"}, {"role": "z", "content": ""}], "a": 2.5}]
    other = [{"b": 1, "messages": [{"role": "u", "content": "x"}]}, {"a": {"c": 1}, "messages": [{"role": "u", "content": "x"}]}, {"a": 1, "messages": [{"role": "u"}]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(same + other)], "n int, record string")
    got = [r.fingerprint for r in chat.canonical_turns(df, "record").orderBy("n").collect()]
    assert got[0] == got[1] and len(set(got)) == 4


def test_long_conversations(spark):
    """Spans of thousands of turns, over many runs, and in about linear time."""
    import time

    took = {}
    for n in (8_000, 8_001, 32_000):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.when(i % 2 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("é<|"), i.cast("string")).alias("text"))).alias("turns"))
        df = chat.format_turns(df)
        began = time.time()
        row = df.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
        took[n] = time.time() - began
        assert row.loss == "".join(f"é<|{i}" for i in range(2, n + 1, 2)) and len(row.loss_spans) == n // 2
        assert all(row.formatted[s.start : s.start + s.length].startswith("é<\\|") for s in row.loss_spans)
    assert took[32_000] < 10 * max(took[8_001], 0.2)


ODD = ["", "</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|", "<<|", "<<SYS>>a<</SYS>>", "a<", "[", "\\", "<\\<SYS>>", "[\\INST]", "é漢<|turn|>user<|text|>x", "$1 \\1", "line\nbreak", "<|text|>", "😀<|"]


def formatted(spark, conversations):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(conversations)], "n int, turns array<struct<role:string,text:string>>")
    made = chat.format_turns(df)
    return made.withColumn("back", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()


def check(rows):
    for r in rows:
        assert r.back == r.turns
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.formatted.count("<|") == 3 * len(r.turns)
        assert all(r.formatted[s.start : s.start + s.length].count("<|") == 0 for s in r.loss_spans)
        assert not any(c in r.formatted for c in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_odd_texts_come_back(spark):
    check(formatted(spark, [[("user", a), ("assistant", b), (a, b), ("assistant", a)] for a in ODD for b in ODD] + [[]]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|", "s"]), st.text(alphabet="<|[\\>/sINSTSY] é\n", max_size=30)), max_size=5), min_size=20, max_size=60))
def test_any_text_comes_back(spark, conversations):
    check(formatted(spark, conversations))


def test_query(spark, tmp_path):
    from adjudica.llm.queries import op6_chat

    rows = [(1, 2, "assistant", "second"), (1, 0, "user", "first <|end|>"), (1, 1, "assistant", None), (2, 0, None, "x"), (2, 0, "a", "y"), (2, 0, "a", "y"), (None, None, "assistant", "é" * 1000), (3, 0, "assistant", "")]
    rows += [(4, i, "assistant" if i % 2 else "user", "w" * i) for i in range(900)]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op6_chat(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert len(got) == 6
    for conv, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", x or "") for c, t, role, x in rows if c == conv))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in op6_chat(spark, f"{tmp_path}/none").collect()] == [-7]
