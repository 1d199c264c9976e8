"""Queries of this subpackage and their SQL, for those that SQL can express."""

from __future__ import annotations

from siftline.llm.decontamination import OP8_SQL, op8_decontamination
from siftline.llm.embedding_dedup import OP1_SQL, op1_embedding_dedup
from siftline.llm.html_text import OP6_SQL, op6_html_extraction
from siftline.llm.language import op3_language_id
from siftline.llm.mixing import OP2_SQL, op2_source_mixing
from siftline.llm.pii import OP9_SQL, op9_pii
from siftline.llm.quality import op10_quality
from siftline.llm.secret_scan import op4_secret_scan
from siftline.llm.simhash import OP5_SQL, op5_simhash_dedup
from siftline.llm.token_rollup import op7_token_rollup

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_source_mixing,
        op3_language_id,
        op4_secret_scan,
        op5_simhash_dedup,
        op6_html_extraction,
        op7_token_rollup,
        op8_decontamination,
        op9_pii,
        op10_quality,
    )
}
ORACLES = {"op1_embedding_dedup": OP1_SQL, "op2_source_mixing": OP2_SQL, "op5_simhash_dedup": OP5_SQL, "op6_html_extraction": OP6_SQL, "op8_decontamination": OP8_SQL, "op9_pii": OP9_SQL}
