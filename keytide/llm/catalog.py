"""Queries of the corpus operators, and their SQL where it can express them."""

from keytide.llm import oracles
from keytide.llm.embeddings import op2_embedding_dedup
from keytide.llm.licenses import op6_license_scan
from keytide.llm.minhash import op9_minhash
from keytide.llm.mixing import op3_source_mixing
from keytide.llm.packing import op4_packing
from keytide.llm.pii import op7_pii
from keytide.llm.quality import op5_quality_rules
from keytide.llm.sharding import op10_sharding
from keytide.llm.substrings import op8_suffix_dedup
from keytide.llm.tokens import op1_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_embedding_dedup, op3_source_mixing, op4_packing, op5_quality_rules,
        op6_license_scan, op7_pii, op8_suffix_dedup, op9_minhash, op10_sharding,
    )
}
#: The others train, sample, pack or encode, or leave a choice open; all are tested against brute force in tests/llm.
ORACLES: dict[str, str] = oracles.ORACLES
