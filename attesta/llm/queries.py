"""The registered queries of the operators of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from attesta.llm import anchors, bpe, collocations, exact_dedup, langid, media, minhash, mixing, pii, suffixes, toxicity, warc, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_language_id": langid.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_image_copies": media.op4_image_copies,
    "op5_minhash": minhash.op5_minhash,
    "op6_repeats": suffixes.op6_repeats,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_warc": warc.op10_warc,
    "op11_anchor_dedup": anchors.op11_anchor_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op11_anchor_dedup": anchors.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
