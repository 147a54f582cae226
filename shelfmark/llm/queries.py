"""The training-data operators over their whole tables, as registered queries, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    decontaminate, hard_negatives, html_wrapper, jaccard_join, lang_id, lm_score, merkle, packing, pii, pq_dedup,
    pu_quality, sharding, substring_dedup,
)
from shelfmark.llm.common import table


def _fold(modulus: int):
    """crc32 of the id as text, modulo a number; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pu_quality.learn(docs, table(spark, sf_dir, "labels"), trusted=_fold(5) != 0)
    scored = pu_quality.score(docs, model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.learn(docs))


def op5_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=8)


def op6_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, capacity=2048)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), held_out=_fold(7) == 2)


def op10_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.link(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 50; ids divisible by 7 count with the next label of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=label)


_NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""

def op12_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = lang_id.predict(docs.select("doc_id", "text"), lang_id.learn(docs, trusted=_fold(4) != 2))
    return told.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document (by checksum of its id) is tampered with: its text's A-Z are lower-cased."""
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return merkle.manifest(table(spark, sf_dir, "documents"), third, F.translate("text", _UPPER, _UPPER.lower()))


def _crc32_sql(text: str) -> str:
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, _: {bit}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _merkle_sql(layers: int = 7, over: int = 3) -> str:
    """Trees of up to 8 ** layers rows a language and 8 ** over languages."""
    def leaf(text: str) -> str:
        told = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
                for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({' || '.join(told)})"

    def tree(name: str, count: int) -> list[str]:
        """{name}_k has the runs of layer k: t, r, dig, m (nodes of the layer), pre and post (a node's siblings)."""
        parts = []
        for k in range(count + 1):
            below = f"{name}_{k - 1}"
            nodes = f"{name}_nodes" if k == 0 else (
                f"(SELECT t, r // 8 AS r, CASE WHEN min(m) > 1 THEN sha256(string_agg(dig, '' ORDER BY r)) ELSE min(dig) "
                f"END AS dig FROM {below} GROUP BY t, r // 8)")
            run = "(PARTITION BY t, r // 8 ORDER BY r ROWS BETWEEN"
            parts.append(
                f"{name}_{k} AS (SELECT t, r, dig, count(*) OVER (PARTITION BY t) AS m, "
                f"coalesce(string_agg(dig, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, "
                f"coalesce(string_agg(dig, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post "
                f"FROM {nodes})")
        return parts

    def climb(name: str, source: str, count: int) -> list[str]:
        """Rows climb the tree layer by layer: prf gathers the siblings, f is the digest folded so far."""
        parts = []
        for k in range(count):
            below = source if k == 0 else f"{name}_up_{k - 1}"
            parts.append(
                f"{name}_up_{k} AS (SELECT x.* EXCLUDE (f, prf), CASE WHEN m > 1 THEN sha256(pre || f || post) ELSE f "
                f"END AS f, prf || CASE WHEN m > 1 THEN pre || post ELSE '' END AS prf FROM {below} x JOIN {name}_{k} y "
                f"ON x.{name}_t = y.t AND x.{name}_r // {8 ** k} = y.r)")
        return parts

    climbed = ", ".join([
        "docs AS (SELECT doc_id, coalesce('=' || lang, '') AS t, " + leaf("text") + " AS leaf, CASE WHEN "
        + _crc32_sql("CAST(doc_id AS VARCHAR)") + " % 3 = 0 THEN "
        + leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')") + " ELSE " + leaf("text") + " END AS f FROM documents)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, '' AS prf FROM docs)",
        "l_nodes AS (SELECT t, r, leaf AS dig FROM d)", *tree("l", layers),
        f"g_nodes AS (SELECT '' AS t, row_number() OVER (ORDER BY encode(t)) - 1 AS r, dig, t AS own FROM l_{layers})",
        *tree("g", over),
        f"start AS (SELECT doc_id, leaf, d.f, prf, d.t AS l_t, d.r AS l_r, g.dig AS subroot, '' AS g_t, g.r AS g_r, "
        f"(SELECT dig FROM g_{over}) AS root FROM d JOIN g_nodes g ON g.own = d.t)",
        *climb("l", "start", layers), *climb("g", f"l_up_{layers - 1}", over)])
    return (f"WITH {climbed} SELECT doc_id, leaf, subroot, root, sha256(prf) AS proof_sha256, f AS folded_root, "
            f"f = root AS verified FROM g_up_{over - 1}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": op1_pu_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_bilstm_crf_pii": op4_bilstm_crf_pii,
    "op5_interleave": op5_interleave,
    "op6_harmonic_pack": op6_harmonic_pack,
    "op7_decontaminate": op7_decontaminate,
    "op8_html_wrapper": op8_html_wrapper,
    "op9_bloom_lm": op9_bloom_lm,
    "op10_pq_dedup": op10_pq_dedup,
    "op11_kronecker_negatives": op11_kronecker_negatives,
    "op12_bigru_language": op12_bigru_language,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def checks() -> dict[str, str]:
    return {"op11_kronecker_negatives": _NEGATIVES, "op13_merkle_manifest": _merkle_sql()}
