"""Queries of the operators, each over its whole table."""

from __future__ import annotations

from lamplight.llm import decontaminate, langid, license_scan, lm, mixing, quality, secrets, simhash, topk, urls
from lamplight.llm.common import table

QUERIES = {
    "op1_lm_scoring": lambda s, d: lm.score(table(s, d, "documents")),
    "op2_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
    "op3_license_scan": lambda s, d: license_scan.scan(table(s, d, "documents")),
    "op4_simhash_near_dedup": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
    "op5_decontaminate": lambda s, d: decontaminate.matches(table(s, d, "documents"), table(s, d, "benchmark")),
    "op6_secret_scan": lambda s, d: secrets.scan(table(s, d, "documents")),
    "op7_url_filter": lambda s, d: urls.filter_urls(table(s, d, "pages")),
    "op8_language_id": lambda s, d: langid.identify(table(s, d, "documents")),
    "op9_exact_top_k": lambda s, d: topk.top_k(table(s, d, "embeddings")),
    "op10_quality_classifier": lambda s, d: quality.quality_classifier(table(s, d, "documents"), table(s, d, "labels")),
}
ORACLES: dict[str, str] = {"op2_mixing": mixing.SQL, "op9_exact_top_k": topk.SQL}
