"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from rankfield.llm import op4_repeated_phrases as op4
from rankfield.llm.op1_pii import op1_pii
from rankfield.llm.op10_simhash import op10_simhash
from rankfield.llm.op2_language_id import op2_language_id
from rankfield.llm.op3_quality_rules import op3_quality_rules
from rankfield.llm.op4_repeated_phrases import op4_repeated_phrases
from rankfield.llm.op5_decontamination import op5_decontamination
from rankfield.llm.op6_toxicity import op6_toxicity
from rankfield.llm.op7_lm_scoring import op7_lm_scoring
from rankfield.llm.op8_token_output import op8_token_output
from rankfield.llm.op9_best_fit_packing import op9_best_fit_packing

QUERIES = {f.__name__: f for f in (op1_pii, op2_language_id, op3_quality_rules, op4_repeated_phrases, op5_decontamination, op6_toxicity, op7_lm_scoring, op8_token_output, op9_best_fit_packing, op10_simhash)}
SQL: dict[str, str] = {"op4_repeated_phrases": op4.SQL}
