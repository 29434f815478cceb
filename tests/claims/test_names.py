import hashlib
import re

from adjudica.plans.queries import QUERIES

NAME = re.compile(r"\b([A-Z][a-z]+)\s+([A-Z])[a-z]+\b")
TEXTS = [
    None, "", "Anna Lee paid", "né Anna Lee – ₹5", "Émile Zola Smith Jones", "Jean Dupré", "Anna Leeé Bob Ray", "éAnna Lee", "Anna Lee", "Anna　Leé",
    "Anna\x1cLee", "Anna​Lee", "²Anna Lee", "Anna Lee½", "_Anna Lee", "Anna Lee_", "张Anna Lee", "Anna Lee张", "“Anna  Lee”", "Anna Leé Bob\nRay", "Ⅷ Anna Lee Ⅷ", "٣Anna Lee", "Anna Lee😀",
]


def test_names_of_all_documents(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.masked_md5 for r in QUERIES["redact_names"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.md5(NAME.sub(r"\1 \2***", t).encode()).hexdigest() for i, t in enumerate(TEXTS)}
