"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.decontaminate import contaminations
from lumora.llm.hash_forest import nearest
from lumora.llm.jaccard_join import jaccard_classes
from lumora.llm.licenses import license_matches
from lumora.llm.mixing import mixture
from lumora.llm.passages import repeated_passages
from lumora.llm.pii import pseudonymised
from lumora.llm.token_records import token_records
from lumora.llm.toxicity import toxicity
from lumora.llm.url_filter import url_verdicts


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(_table(spark, sf_dir, "documents"), byte_bpe(), end_id=2)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"))


def op7_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    found = (
        op1_feistel_pseudonyms,
        op2_benchmark_decontamination,
        op3_ngram_jaccard_join,
        op4_token_records,
        op5_license_scan,
        op6_source_mixing,
        op7_hash_prefix_forest,
        op8_repeated_passages,
        op9_toxicity,
        op10_url_filter,
    )
    return {f.__name__: f for f in found}


OP3_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), e AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS root FROM s UNION SELECT p.y, r.root FROM reach r JOIN p ON p.x = r.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(root) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id,
    CAST((SELECT count(*) FROM p WHERE p.x = s.doc_id) AS BIGINT) AS n_links
FROM s
"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

#: Every diagonal of a document and an item on which enough words agree, and of it all windows that agree.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), i AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark)),
n AS (SELECT item, len(w) AS size, least(13, len(w)) AS wide, CASE WHEN len(w) >= 13 THEN 11 WHEN len(w) >= 8 THEN len(w) - 1 ELSE len(w) END AS need FROM i WHERE len(w) > 0),
dw AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d), iw AS (SELECT item, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM i),
m AS (SELECT r, item, p - q AS shift, list(p) AS ps FROM dw JOIN iw USING (word) GROUP BY r, item, p - q HAVING count(*) >= 1),
k AS (SELECT m.*, n.wide, n.need, greatest(0, shift) AS a, least(len(d.w), shift + n.size) AS b FROM m JOIN n USING (item) JOIN d USING (r) WHERE len(ps) >= need),
s AS (SELECT *, list_filter(range(a, b - wide + 1), lambda x: len(list_filter(ps, lambda y: y >= x AND y < x + wide)) >= need) AS starts FROM k WHERE b - a >= wide),
c AS (SELECT *, list_filter(range(a, b), lambda y: len(list_filter(starts, lambda x: y >= x AND y < x + wide)) > 0) AS covered FROM s WHERE len(starts) > 0),
f AS (SELECT r, item, shift, list_min(starts) AS start_word, len(covered) AS n_words, len(list_intersect(covered, ps)) AS n_agree FROM c),
best AS (SELECT *, row_number() OVER (PARTITION BY r, item ORDER BY n_agree DESC, start_word, shift) AS o FROM f)
SELECT d.doc_id, i.item_id, CAST(start_word AS BIGINT) AS start_word, CAST(n_words AS BIGINT) AS n_words, CAST(n_agree AS BIGINT) AS n_agree FROM best JOIN d USING (r) JOIN i USING (item) WHERE o = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op3_ngram_jaccard_join": OP3_SQL}
