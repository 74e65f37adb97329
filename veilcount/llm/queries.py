"""The training-data queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontaminate
from .divergence import OP12_SQL, op12_source_divergence
from .language_id import op5_language_id
from .license_scan import op13_license_scan
from .near_dedup import op7_near_dedup
from .pieces import op10_sentencepiece
from .quality import op4_quality
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op6_suffix_dedup
from .top_k import OP2_SQL, op2_top_k
from .toxicity import op9_toxicity
from .url_filter import OP1_SQL, op1_url_filter
from .vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_top_k": op2_top_k,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_source_divergence": op12_source_divergence,
    "op13_license_scan": op13_license_scan,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_top_k": OP2_SQL,
    "op8_decontaminate": OP8_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
