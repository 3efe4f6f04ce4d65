"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import op10_license, op11_merkle, op12_prefix_bpe, op13_variants
from tessera.llm.op1_hmm import op1_hmm
from tessera.llm.op2_near_dedup import op2_near_dedup
from tessera.llm.op3_pii import op3_pii
from tessera.llm.op4_warc import op4_warc
from tessera.llm.op5_decontaminate import op5_decontaminate
from tessera.llm.op6_fingerprint import op6_fingerprint
from tessera.llm.op7_quality import op7_quality
from tessera.llm.op8_bpe import op8_bpe
from tessera.llm.op9_langid import op9_langid

QUERIES = {
    "op1_hmm": op1_hmm,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_decontaminate": op5_decontaminate,
    "op6_fingerprint": op6_fingerprint,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_langid": op9_langid,
    "op10_license": op10_license.op10_license,
    "op10_license_runs": op10_license.op10_license_runs,
    "op11_merkle": op11_merkle.op11_merkle,
    "op12_prefix_bpe": op12_prefix_bpe.op12_prefix_bpe,
    "op13_variants": op13_variants.op13_variants,
}
ORACLE_SQL = {"op10_license": op10_license.oracle_sql(), "op11_merkle": op11_merkle.oracle_sql(), "op13_variants": op13_variants.oracle_sql()}
