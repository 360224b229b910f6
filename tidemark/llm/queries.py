"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidemark.llm.decontaminate import op10_decontaminate
from tidemark.llm.langid import op8_langid
from tidemark.llm.licenses import OP3_SQL, op3_licenses
from tidemark.llm.minmax import OP5_SQL, op5_near_duplicates
from tidemark.llm.mixing import op4_mixing
from tidemark.llm.pii import op1_pii
from tidemark.llm.quality import OP7_SQL, op7_quality
from tidemark.llm.secrets import op2_secrets
from tidemark.llm.tokenbin import op9_tokens
from tidemark.llm.toxicity import op6_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_secrets, op3_licenses, op4_mixing, op5_near_duplicates, op6_toxicity, op7_quality, op8_langid, op9_tokens, op10_decontaminate)
}
ORACLE = {"op3_licenses": OP3_SQL, "op5_near_duplicates": OP5_SQL, "op7_quality": OP7_SQL}
