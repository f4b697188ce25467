"""The driver's queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .language_id import identify
from .line_dedup import line_digest
from .minhash import near_dedup
from .mixing import mix
from .packing import pack
from .quality import score_quality
from .substring_dedup import substring_digest
from .token_files import token_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=4, held=2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(_table(spark, sf_dir, "documents"), window=35)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"), least=0.93, leaf=256)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), repeat=3).drop("pattern")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), percent=85, n_words=3)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"), folds=5, held=0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, size=4096)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality": op2_quality,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_mixing": op5_mixing,
        "op6_minhash": op6_minhash,
        "op7_line_dedup": op7_line_dedup,
        "op8_language_id": op8_language_id,
        "op9_packing": op9_packing,
        "op10_token_files": op10_token_files,
    }


_OP1 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


_OP7 = """
WITH lines AS (
    SELECT d.doc_id, i AS pos, split_part(coalesce(d.text, ''), chr(10), i) AS line
    FROM documents d, LATERAL (SELECT unnest(range(1, length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), chr(10), '')) + 2)) AS i)
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), often AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_OP3 = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
    SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i) WHERE len(ws) >= 35
), dup AS (
    SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT doc_id, p FROM win JOIN dup USING (h), LATERAL (SELECT unnest(range(i, i + 35)) AS p)
), word AS (
    SELECT doc_id, p, ws[p] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS p)
), kept AS (
    SELECT word.doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t
    FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_OP4 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), p AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM reach r JOIN p ON r.other = p.a
), c AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), n AS (
    SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""

_OP6 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 1, 2))) AS i) WHERE len(ws) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), c AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op3_substring_dedup": _OP3, "op4_embedding_dedup": _OP4, "op6_minhash": _OP6, "op7_line_dedup": _OP7}
