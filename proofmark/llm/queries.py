"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import compaction, decontam, jaccard, langid, lexical, licenses, mixing, quality, secrets, substrings, topk, urls, warc

QUERIES = {
    "op1_language_mixture": langid.op1,
    "op2_warc_normalise": warc.op2,
    "op3_quality_fourier": quality.op3,
    "op4_secret_randomness": secrets.op4,
    "op5_license_spans": licenses.op5,
    "op6_waterfill_mix": mixing.op6,
    "op7_jaccard_components": jaccard.op7,
    "op8_benchmark_decontam": decontam.op8,
    "op9_substring_dedup": substrings.op9,
    "op10_exact_topk": topk.op10,
    "op11_wand_search": lexical.op11,
    "op12_executed_compaction": compaction.op12,
    "op13_url_filter": urls.op13,
}
ORACLES = {
    "op2_warc_normalise": warc.ORACLE,
    "op6_waterfill_mix": mixing.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op11_wand_search": lexical.ORACLE,
    "op13_url_filter": urls.ORACLE,
}
