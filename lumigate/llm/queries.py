"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lumigate.llm.binary_output import op9_binary_output
from lumigate.llm.decontaminate import op7_decontaminate
from lumigate.llm.embedding_dedup import SQL as EMBEDDING_SQL
from lumigate.llm.embedding_dedup import op1_embedding_dedup
from lumigate.llm.filter_audit import SQL as AUDIT_SQL
from lumigate.llm.filter_audit import op12_filter_audit
from lumigate.llm.line_dedup import op3_line_dedup
from lumigate.llm.mixing import mixing_sql, op4_mixing
from lumigate.llm.ngram_join import op8_ngram_join
from lumigate.llm.pii import op10_personal_data
from lumigate.llm.prefix_trie import SQL as TRIE_SQL
from lumigate.llm.prefix_trie import op11_prefix_trie
from lumigate.llm.quality import op13_quality_rules
from lumigate.llm.secrets import op6_secrets
from lumigate.llm.token_counts import op5_token_counts
from lumigate.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_ngram_join": op8_ngram_join,
    "op9_binary_output": op9_binary_output,
    "op10_personal_data": op10_personal_data,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": EMBEDDING_SQL, "op4_mixing": mixing_sql(), "op11_prefix_trie": TRIE_SQL, "op12_filter_audit": AUDIT_SQL}
