"""The queries that apply each corpus operator to its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import caps, fim, fingerprints, jaccard, langid, lines, ngrams, packing, quality, sentencepieces, substrings, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing": fingerprints.op1_winnowing,
        "op2_lines": lines.op2_lines,
        "op3_caps": caps.op3_caps,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_substrings": substrings.op5_substrings,
        "op6_language": langid.op6_language,
        "op7_interpolation": ngrams.op7_interpolation,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_packing": packing.op9_packing,
        "op10_pieces": sentencepieces.op10_pieces,
        "op11_fim": fim.op11_fim,
        "op12_trie": trie.op12_trie,
        "op13_quality": quality.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fim": fim.SQL, "op12_trie": trie.SQL}
