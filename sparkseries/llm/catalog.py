"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .ann import op1_adaptive_scan
from .bpe import op5_byte_bpe
from .dac import op10_token_dac
from .line_dedup import OP2_SQL, op2_line_dedup
from .ngram_join import op4_ngram_jaccard
from .merkle import OP11_SQL, op11_octopus_manifest
from .mixing import op9_entropy_mixing
from .ppm import op8_ppm_language
from .quality import op3_quality_rules
from .sharding import op12_karmarkar_karp
from .spelling import OP13_SQL, op13_trie_pairs
from .suffix_dedup import OP7_SQL, op7_sparse_suffix
from .toxicity import op6_compression_toxicity

QUERIES = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_compression_toxicity": op6_compression_toxicity,
    "op7_sparse_suffix": op7_sparse_suffix,
    "op8_ppm_language": op8_ppm_language,
    "op9_entropy_mixing": op9_entropy_mixing,
    "op10_token_dac": op10_token_dac,
    "op11_octopus_manifest": op11_octopus_manifest,
    "op12_karmarkar_karp": op12_karmarkar_karp,
    "op13_trie_pairs": op13_trie_pairs,
}

ORACLE: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op7_sparse_suffix": OP7_SQL, "op11_octopus_manifest": OP11_SQL,
                          "op13_trie_pairs": OP13_SQL}
