"""The registered queries of this folder, and check SQL where SQL gives their results."""

from __future__ import annotations

from barsmith.llm import minhash, negatives, variants
from barsmith.llm.decontaminate import op8_decontamination
from barsmith.llm.encode import op4_sentencepiece
from barsmith.llm.jaccard import op6_ngram_jaccard
from barsmith.llm.language import op3_language_id
from barsmith.llm.lines import op1_line_dedup
from barsmith.llm.minhash import op12_minhash
from barsmith.llm.negatives import op13_hard_negatives
from barsmith.llm.quality import op9_quality_rules
from barsmith.llm.secret_scan import op10_secret_scan
from barsmith.llm.shards import op5_kd_sharding
from barsmith.llm.tokencount import op2_token_counts
from barsmith.llm.urls import op7_url_filter
from barsmith.llm.variants import op11_spelling_variants

QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_token_counts, op3_language_id, op4_sentencepiece, op5_kd_sharding,
    op6_ngram_jaccard, op7_url_filter, op8_decontamination, op9_quality_rules, op10_secret_scan,
    op11_spelling_variants, op12_minhash, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": variants.SQL, "op12_minhash": minhash.SQL,
    "op13_hard_negatives": negatives.SQL}
