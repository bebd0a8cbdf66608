"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import automata, chat, collocations, exact_dedup, licenses, mixing, ngram_join, pieces, pii, quality, repeats, token_links, url_rules
from tickloom.llm.text import table


def _on_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": pieces.query,
    "op2_exact_dedup": _on_documents(exact_dedup.exact_dedup),
    "op3_chat_formatting": chat.query,
    "op4_url_filters": url_rules.query,
    "op5_source_mixing": _on_documents(mixing.mix),
    "op6_quality_rules": quality.query,
    "op7_repeated_strings": repeats.query,
    "op8_license_scan": licenses.query,
    "op9_personal_data": pii.query,
    "op10_ngram_jaccard": ngram_join.query,
    "op11_collocations": collocations.query,
    "op12_token_links": token_links.query,
    "op13_repeated_passages": automata.query,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_chat_formatting": chat.SQL,
    "op5_source_mixing": mixing.SQL,
    "op10_ngram_jaccard": ngram_join.SQL,
    "op11_collocations": collocations.SQL,
    "op13_repeated_passages": automata.SQL,
}
