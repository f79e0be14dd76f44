"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from docbasin.llm.align import op13_align
from docbasin.llm.bpe import op10_bpe
from docbasin.llm.decontam import OP3_SQL, op3_decontam
from docbasin.llm.langid import op6_langid
from docbasin.llm.lexical import OP11_SQL, op11_lexical
from docbasin.llm.lm import op4_lm
from docbasin.llm.mainhtml import op5_mainhtml
from docbasin.llm.mpeg import op9_mpeg
from docbasin.llm.neardup import OP7_SQL, op7_neardup
from docbasin.llm.pii import op8_pii
from docbasin.llm.secrets import OP12_SQL, op12_secrets
from docbasin.llm.toxicity import op1_toxicity
from docbasin.llm.urlrules import OP2_SQL, op2_urlrules

QUERIES = {"op1_toxicity": op1_toxicity, "op2_urlrules": op2_urlrules, "op3_decontam": op3_decontam, "op4_lm": op4_lm, "op5_mainhtml": op5_mainhtml, "op6_langid": op6_langid, "op7_neardup": op7_neardup, "op8_pii": op8_pii, "op9_mpeg": op9_mpeg, "op10_bpe": op10_bpe, "op11_lexical": op11_lexical, "op12_secrets": op12_secrets, "op13_align": op13_align}
ORACLE = {"op2_urlrules": OP2_SQL, "op3_decontam": OP3_SQL, "op7_neardup": OP7_SQL, "op11_lexical": OP11_SQL, "op12_secrets": OP12_SQL}
