import re

from adjudica.llm import licenses as L

SCHEMA = "doc_id long, text string, unit string, dice string"


def plain(rows, least=L.LEAST):
    def bigrams(x):
        words = re.sub("[^a-z0-9]+", " ", x.translate(str.maketrans(L.UPPER, L.LOWER))).split()
        return list(zip(words, words[1:]))

    out = []
    for doc_id, text in rows:
        if not text:
            continue
        paragraphs = re.split("\n[ \t\r]*\n", text)
        units = [("line", i, x) for i, x in enumerate(text.split("\n"))] + [("paragraph", i, x) for i, x in enumerate(paragraphs) if "\n" in x]
        sentences = [x for x in re.sub(r"([.!?])[ \t\n\x0b\f\r]+", "\\1\x01", re.sub("\n[ \t\r]*\n", "\x01", text)).split("\x01") if x]
        units += [("sentence", i, x) for i, x in enumerate(sentences)] if len(sentences) > 1 else []
        units += [("text", 0, text)] if len(paragraphs) > 1 else []
        for kind, i, x in units:
            own = bigrams(x)
            for name, template in L.TEMPLATES.items():
                other = bigrams(template)
                both = sum(min(own.count(b), other.count(b)) for b in set(other))
                if own and 2 * both / (len(own) + len(other)) >= least:
                    out.append((doc_id, kind, i, name, len(own), round(2 * both / (len(own) + len(other)), 9)))
    return sorted(out, key=str)


def test_against_all_templates(spark):
    header, mit = L.TEMPLATES["Apache-2.0-header"], L.TEMPLATES["MIT-permission"]
    wrapped = "\n".join(re.findall(r".{1,60}(?:\s|$)", mit))
    rows = [
        (1, "prose here\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "LICENSED  under CC-BY-NC 4.0!"), (3, "Released under the MIT Licence"), (4, header), (5, header.replace("compliance", "accord").replace("limitations", "limits")),
        (6, f"Title\n\n{wrapped}\n\n{wrapped}"), (7, wrapped.replace("\n", " \r\n")), (8, None), (9, ""), (10, "the the the the the the the the\n\n\n"), (11, "one"), (12, "é " * 50 + "Released under the MIT License."), (None, "Released under the MIT License."), (2, "Released under the MIT License."), (2, "Released under the MIT License."),
        (13, " ".join(["Released under the MIT License."] * 3000)), (14, "permission\n\n" + mit),
        (15, "A long line of prose. Released under the MIT License. And it goes on for a while here."), (16, "Words that stand\nbefore it. This project is licensed\nunder the terms of the\nMIT License. And after it\ncomes more."),
    ]
    df = spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.unit, r.unit_no, r.license_id, r.n_bigrams, round(r.dice, 9)) for r in L.scan(df).collect()), key=str)
    assert got == plain(rows) and len(got) >= 12 and {(15, "sentence"), (16, "sentence")} <= {r[:2] for r in got}
    every = L.scan(df, tell=False).collect()  # what telling words leave out has no match
    assert sorted(((r.doc_id, r.unit, r.unit_no, r.license_id, r.n_bigrams, round(r.dice, 9)) for r in every), key=str) == got
    assert L.scan(df.limit(0)).collect() == []


def test_size_bounds_lose_nothing():
    for size in range(1, 150):
        lo, hi = L.bounds(size, 0.8)
        for other in range(1, 400):
            if 2 * min(size, other) / (size + other) >= 0.8:
                assert lo <= other <= hi


def test_telling_words_lose_nothing():
    words = L.telling_words(L.TEMPLATES, L.LEAST)
    for text in L.TEMPLATES.values():
        own = L.bigrams_of(text)
        untold = [b for b in own if not set(b.split()) & set(words)]
        assert 2 * len(untold) / (len(own) + len(untold)) < L.LEAST
