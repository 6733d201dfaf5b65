"""The registered queries of this subpackage: production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import jaccard, licences, neighbours, packing, pieces, quality_rules, repair, style_tree, suffixes, token_files, topk, toxicity, trie
from cohortflow.llm.labelled import held_out
from cohortflow.llm.turn_sql import LICENCE_SQL, REPAIR_SQL, TRIE_SQL
from cohortflow.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


@query("op1_style_tree")
def op1(spark, sf):
    return style_tree.extract(table(spark, sf, "pages"))


@query("op2_suffix_dedup")
def op2(spark, sf):
    return suffixes.remove_repeats(table(spark, sf, "documents")).drop("kept", "spans")


@query("op3_packing")
def op3(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path(WORD_BPE))


@query("op4_token_files")
def op4(spark, sf):
    path = token_files.write_tokens(table(spark, sf, "documents"), public_tokenizers.path(WORD_BPE), shared_dir(spark))
    return token_files.checksums(spark, path)


@query("op5_quality_rules")
def op5(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality_rules.fit(docs, table(spark, sf, "labels"))
    return quality_rules.judge(docs, model)


@query("op9_neighbour_votes")
def op9(spark, sf):
    docs = table(spark, sf, "documents")
    model = neighbours.fit(docs, table(spark, sf, "labels"))
    return neighbours.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= neighbours.THRESHOLD).cast("int").alias("predicted"))


@query("op10_toxicity")
def op10(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op7_impact_top_k", TOP_K_SQL)
def op7(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_jaccard_join")
def op6(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents"), percent=90, n=3)


@query("op8_piece_sampling")
def op8(spark, sf):
    return pieces.sample(table(spark, sf, "documents"), public_tokenizers.path(PIECES))


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark, sf):
    return trie.trie(*trie.rebased(trie.turns(table(spark, sf, "conversations")))).drop("turn_id")


@query("op12_structure_repair", REPAIR_SQL)
def op12(spark, sf):
    return repair.digests(repair.damage(table(spark, sf, "conversations")))


@query("op13_license_scan", LICENCE_SQL)
def op13(spark, sf):
    return licences.scan(table(spark, sf, "documents"))
