"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from ledgerloom.llm import byte_bpe, gif, importance, knn, licences, line_dedup, mixing, ngram_join, pieces, secrets, spelling, toxicity, urls

QUERIES = {
    "op1_piece_sampling": pieces.op1,
    "op2_licence_digest": licences.op2,
    "op3_voronoi_knn": knn.op3,
    "op4_secret_battery": secrets.op4,
    "op5_gif_media": gif.op5,
    "op6_redirect_verdict": urls.op6,
    "op7_toxicity_boosted": toxicity.op7,
    "op8_token_group_join": ngram_join.op8,
    "op9_entropy_mix": mixing.op9,
    "op10_site_line_dedup": line_dedup.op10,
    "op11_crc_ring_resampling": importance.op11,
    "op12_prefix_bpe": byte_bpe.op12,
    "op13_parity_mask_variants": spelling.op13,
}

ORACLE_SQL = {
    "op8_token_group_join": ngram_join.OP8_SQL,
    "op3_voronoi_knn": knn.OP3_SQL,
    "op2_licence_digest": licences.OP2_SQL,
    "op6_redirect_verdict": urls.OP6_SQL,
    "op10_site_line_dedup": line_dedup.OP10_SQL,
    "op11_crc_ring_resampling": importance.OP11_SQL,
    "op13_parity_mask_variants": spelling.OP13_SQL,
}
