"""The queries of this package: one per operator over its whole table, and the pipeline's pieces, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adjudica.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adjudica.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits per document, placed by hash: an insertion, a deletion and a replacement."""
    from pyspark.sql import functions as F

    from adjudica.llm.edit_counts import count_edited

    def edit(nth: int, deleted: int, inserted: str):
        place = F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(nth)), F.coalesce(F.length("text"), F.lit(0)) + 1)
        return F.struct(place.cast("long").alias("position"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))

    edits = F.array(edit(1, 0, " one more sentence, put in here. "), edit(2, 9, ""), edit(3, 4, "changed"))
    return count_edited(table(spark, sf_dir, "documents").withColumn("edits", edits))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adjudica.llm.matroska import read_media, store_media

    return read_media(store_media(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adjudica.llm.mixing import shares

    return shares(table(spark, sf_dir, "documents")).selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adjudica.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from adjudica.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    records = chat.records_from_rows(rows.unionByName(probe))
    formatted = chat.format_turns(chat.canonical_turns(records, "record")).select("conv_id", "formatted", "loss_spans")
    read = formatted.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adjudica.llm.balltree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from adjudica.llm.simhash import link

    linked = link(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adjudica.llm.toxicity import fit, score

    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adjudica.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || md5(coalesce(text, '')) AS name,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(weight * max(CASE WHEN weight * level <= cap THEN level END) OVER (), cap) AS target FROM l),
r AS (SELECT doc_id, name, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT r.*, k, ('0x' || substr(md5(name || chr(31) || (k // 4)::VARCHAR), (k % 4 * 8 + 1)::INTEGER, 8))::BIGINT / 4294967296.0 AS u FROM r, range(16) x(k)),
c AS (SELECT *, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u),
o AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken)::BIGINT - any_value(target)), k) AS place FROM c GROUP BY source, k)
SELECT doc_id, size, source_size, target, taken FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source AND c.k = o.k AND place = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_edit_counts": op2_edit_counts,
    "op3_matroska": op3_matroska,
    "op4_mixing": op4_mixing,
    "op5_licenses": op5_licenses,
    "op6_chat": op6_chat,
    "op7_balltree": op7_balltree,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
}
OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.r AS asked, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r),
t AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


def op5_sql() -> str:
    from adjudica.llm.licenses import LEAST, LOWER, TEMPLATES, UPPER, template_rows

    rows = ", ".join(f"('{n}', {size}, {lo!r}::DOUBLE, {hi!r}::DOUBLE, '{b}', {k})" for n, size, lo, hi, b, k in template_rows(TEMPLATES, LEAST))
    return rf"""
WITH t(license_id, template_bigrams, lo, hi, bigram, times) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_split_to_array(text, '\n[ \t\r]*\n') AS p FROM documents WHERE text IS NOT NULL AND text <> ''),
q AS (SELECT r, doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '\n[ \t\r]*\n', chr(1), 'g'), '([.!?])[\t-\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS q FROM d),
u AS (SELECT r, doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS unit_no, unnest(string_split(text, chr(10))) AS x FROM d
    UNION ALL SELECT * FROM (SELECT r, doc_id, 'paragraph', unnest(range(len(p))), unnest(p) AS x FROM d) WHERE contains(x, chr(10))
    UNION ALL SELECT r, doc_id, 'sentence', unnest(range(len(q))), unnest(q) FROM q WHERE len(q) > 1
    UNION ALL SELECT r, doc_id, 'text', 0, text FROM d WHERE len(p) > 1),
n AS (SELECT r, doc_id, unit, unit_no, string_split(trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT r, doc_id, unit, unit_no, len(w) - 1 AS n_bigrams, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM n),
m AS (SELECT r, doc_id, unit, unit_no, license_id, n_bigrams, template_bigrams, bigram, least(count(*), any_value(times)) AS n_common
    FROM b JOIN t USING (bigram) WHERE n_bigrams BETWEEN lo AND hi GROUP BY ALL),
s AS (SELECT r, doc_id, unit, unit_no, license_id, n_bigrams, 2.0::DOUBLE * sum(n_common)::BIGINT / (n_bigrams + template_bigrams) AS dice
    FROM (SELECT * FROM m) GROUP BY r, doc_id, unit, unit_no, license_id, n_bigrams, template_bigrams)
SELECT doc_id, unit, unit_no::INTEGER AS unit_no, license_id, n_bigrams::BIGINT AS n_bigrams, dice FROM s WHERE dice >= {LEAST}
"""


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(role, '([<\[])(\\*)(\|)', '\1\\\2\3', 'g'), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'), '(<)(\\*)(</?SYS>>)', '\1\\\2\3', 'g') AS erole,
    regexp_replace(regexp_replace(regexp_replace(text, '([<\[])(\\*)(\|)', '\1\\\2\3', 'g'), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'), '(<)(\\*)(</?SYS>>)', '\1\\\2\3', 'g') AS etext FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(erole) + length(etext) + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE: dict[str, str] = {"op5_licenses": op5_sql(), "op6_chat": OP6_SQL, "op4_mixing": OP4_SQL, "op7_balltree": OP7_SQL}
