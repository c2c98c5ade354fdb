"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import codebooks, exact_dedup, html_extract, license_scan, media, mixing, neighbours, ngram_join, packing, sharding, spelling, token_counts, toxicity


def queries() -> dict:
    return {"op1_toxicity": toxicity.op1, "op2_pack": packing.op2, "op3_token_counts": token_counts.op3, "op4_ngram_join": ngram_join.op4, "op5_html_extract": html_extract.op5, "op6_license_scan": license_scan.op6, "op7_exact_dedup": exact_dedup.op7, "op8_media": media.op8, "op9_shards": sharding.op9, "op10_mix_sources": mixing.op10, "op11_spelling": spelling.op11, "op12_neighbours": neighbours.op12, "op13_codebooks": codebooks.op13}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.OP7_SQL, "op10_mix_sources": mixing.OP10_SQL, "op11_spelling": spelling.OP11_SQL, "op13_codebooks": codebooks.OP13_SQL}
