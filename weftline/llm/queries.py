"""The queries of the operators in this subpackage, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .chat import OP10_SQL, op10_chat
from .clusters import OP11_SQL, op11_delta_lloyd
from .jaccard import op3_ngram_join
from .lm import op5_attention_lm
from .mixing import OP8_SQL, op8_poisson_mix
from .ordinal import op9_ordinal
from .phrases import OP13_SQL, op13_phrases
from .pii import op4_pii
from .quality import op1_quality_rules
from .rans import op2_rans
from .simhash import op7_simhash
from .toxicity import op12_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_rans": op2_rans,
    "op3_ngram_join": op3_ngram_join,
    "op4_pii": op4_pii,
    "op5_attention_lm": op5_attention_lm,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_ordinal": op9_ordinal,
    "op10_chat": op10_chat,
    "op11_delta_lloyd": op11_delta_lloyd,
    "op12_toxicity": op12_toxicity,
    "op13_phrases": op13_phrases,
}
ORACLE: dict[str, str] = {
    "op8_poisson_mix": OP8_SQL,
    "op10_chat": OP10_SQL,
    "op11_delta_lloyd": OP11_SQL,
    "op13_phrases": OP13_SQL,
}
