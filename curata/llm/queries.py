"""The queries of this subpackage and their SQL; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from curata.llm import bpe, conversation_trie, decontamination, embedding_dedup, exact_dedup, html_text, language_model, licences, minhash, mixing, quality, search, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_warc": warc.op2_warc,
    "op3_quality": quality.op3_quality,
    "op4_language_model": language_model.op4_language_model,
    "op5_minhash": minhash.op5_minhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_licences": licences.op8_licences,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_html_text": html_text.op10_html_text,
    "op11_search": search.op11_search,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_decontamination": decontamination.op13_decontamination,
    "pipeline": pipeline,
}

#: Where SQL cannot express an operator (op3, op4, op6 and the pipeline), tests compare it with a brute-force version.
ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op2_warc": warc.SQL,
    "op5_minhash": minhash.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_licences": licences.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
    "op10_html_text": html_text.SQL,
    "op11_search": search.SQL,
    "op12_conversation_trie": conversation_trie.SQL,
    "op13_decontamination": decontamination.SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
