import math
import random
import zlib

import numpy as np
import pyarrow as pa
from test_jaccard import plain_kept
from test_tokens import whole

import corpus_pipeline as C
from adjudica.llm import mixing, toxicity


def corpus(tmp_path, spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "be") for b in ("ra", "ne", "so") for c in ("", "t", "ling", "pa")]
    rows, labels = [], []
    for i in range(360):
        text = [rng.choice(words) for _ in range(rng.choice([4, 30, 120, 500]))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["vilescum", "foulbeast"]))
        rows.append((i, " ".join(text), "en", rng.choice(["a", "b", "c", None]), 0))
        labels.append((i, 1, toxic))
    clean = [r for r, (*_, toxic) in zip(rows, labels) if not toxic]
    rows += [(1000 + i, r[1], "en", "b", 0) for i, r in enumerate(clean[:30])]  # exact copies
    rows += [(2000 + i, r[1].replace(" ", "  ", 3) + "\n", "en", "c", 0) for i, r in enumerate(clean[30:50])]
    rows += [(3000, None, None, None, None), (3001, "", "en", "a", 0), (3002, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, {i: t for i, _, t in labels}


def test_stages_as_by_plain_code(spark, tmp_path):
    rows, truth = corpus(tmp_path, spark)
    docs, sf_dir = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    columns, out = docs.columns, {}
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), name)
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    model = toxicity.fit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    scores = model.scores(pa.array([r[1] for r in rows], pa.string()))
    clean = [r for r, s in zip(rows, scores) if s < 0.5]
    assert sorted(r.doc_id for r in out["toxicity"]) == sorted(r[0] for r in clean)
    kept = {r.doc_id for r in out["toxicity"]}
    assert sum((i in kept) == (not t) for i, t in truth.items()) / len(truth) > 0.95

    firsts = plain_kept(clean)
    assert sorted(r.doc_id for r in out["simhash"]) == firsts

    single = [r for r in rows if r[0] in set(firsts)]
    sizes = {}
    for r in single:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    got = {r.doc_id: 0 for r in out["simhash"]}
    for r in out["mixing"]:
        got[r.doc_id] += 1
    targets = {r.source: r.target for r in mixing.shares(spark.createDataFrame(out["simhash"], spark.read.parquet(f"{tmp_path}/documents.parquet").schema)).collect()}
    for r in single:
        rate = targets[r[3]] / sizes[r[3]] if sizes[r[3]] else 0
        assert got[r[0]] in (math.floor(rate), math.ceil(rate))

    texts = {r[0]: r[1] for r in rows}
    want = sorted((r.doc_id, start, zlib.crc32(ids[start : start + 2048])) for r in out["mixing"] for ids in [np.array([*whole(texts[r.doc_id]), 1], "<u4")] for start in range(0, len(ids), 2048))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in out["packing"]) == want

    again = C.run(spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out["packing"]))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
