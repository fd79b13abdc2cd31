"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, extract, fingerprint, jaccard, langid, lmscore, mixing, quality, ranked, runs, sharding, suffixes, warc

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_extract": extract.op5_extract,
    "op6_langid": langid.op6_langid,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_sharding": sharding.op8_sharding,
    "op9_lmscore": lmscore.op9_lmscore,
    "op10_warc": warc.op10_warc,
    "op11_runs": runs.op11_runs,
    "op12_suffixes": suffixes.op12_suffixes,
    "op13_ranked": ranked.op13_ranked,
}
ORACLE: dict[str, str] = {
    "op3_mixing": mixing.OP3_SQL,
    "op4_jaccard": jaccard.OP4_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
    "op13_ranked": ranked.OP13_SQL,
}
