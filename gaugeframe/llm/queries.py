"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from gaugeframe.llm.decontam import op7_decontamination
from gaugeframe.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from gaugeframe.llm.langid import op8_language_id
from gaugeframe.llm.lm_score import op1_lm_scoring
from gaugeframe.llm.mixing import op6_mixing
from gaugeframe.llm.site_lines import OP5_SQL, op5_line_dedup
from gaugeframe.llm.suffix_dedup import op10_suffix_dedup
from gaugeframe.llm.topk import OP3_SQL, op3_exact_topk
from gaugeframe.llm.toxicity import op9_toxicity
from gaugeframe.llm.unit_dedup import OP4_SQL, op4_substring_dedup


def queries() -> dict:
    named = (op1_lm_scoring, op2_jaccard_join, op3_exact_topk, op4_substring_dedup, op5_line_dedup, op6_mixing, op7_decontamination, op8_language_id, op9_toxicity, op10_suffix_dedup)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op3_exact_topk": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL}
