"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, external_shuffle, fill_in_middle, filter_audit, hnsw, line_dedup, near_dedup, packing, pii, quality, reply_trees, warc, wavelet

QUERIES = {
    "op1_crf": pii.query,
    "op2_winnowing": decontaminate.query,
    "op3_line_windows": line_dedup.query,
    "op4_wavelet": wavelet.query,
    "op5_setsketch": near_dedup.query,
    "op6_warc": warc.query,
    "op7_neighbours": quality.query,
    "op8_hnsw": hnsw.query,
    "op9_external_shuffle": external_shuffle.query,
    "op10_harmonic": packing.query,
    "op11_lookaround": fill_in_middle.query,
    "op12_replay": filter_audit.query,
    "op13_reply_trees": reply_trees.query,
}
ORACLE_SQL = {
    "op2_winnowing": decontaminate.ORACLE,
    "op3_line_windows": line_dedup.ORACLE,
    "op11_lookaround": fill_in_middle.ORACLE,
    "op12_replay": filter_audit.ORACLE,
    "op13_reply_trees": reply_trees.ORACLE,
}
