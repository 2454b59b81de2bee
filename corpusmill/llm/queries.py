"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_byte_bpe
from .langid import op10_language_id
from .merkle import op3_fingerprints
from .mixing import OP6_SQL, op6_mixing
from .periodic import op13_periodic_runs
from .pieces import op11_sentencepiece
from .quality import op1_quality
from .rules import OP4_SQL, op4_quality_rules
from .simhash import op9_simhash
from .tokencount import op8_token_counts
from .toxicity import op5_toxicity
from .turntrie import OP12_SQL, op12_prefix_trie
from .webtext import op7_html_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_byte_bpe, op3_fingerprints, op4_quality_rules, op5_toxicity,
        op6_mixing, op7_html_text, op8_token_counts, op9_simhash, op10_language_id,
        op11_sentencepiece, op12_prefix_trie, op13_periodic_runs,
    )
}
SQL: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op6_mixing": OP6_SQL, "op12_prefix_trie": OP12_SQL}
