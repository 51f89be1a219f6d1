"""Queries and SQL of the training-data operators, for the repository's entry module."""

from __future__ import annotations

from quillgrid.llm.ann import op2_ann_partitions
from quillgrid.llm.bpe import op13_bpe_codec
from quillgrid.llm.chat import OP10_SQL, op10_chat_format
from quillgrid.llm.decontaminate import op4_decontaminate
from quillgrid.llm.jaccard import OP9_SQL, op9_ngram_jaccard
from quillgrid.llm.mixing import OP8_SQL, op8_mix_sources
from quillgrid.llm.pii import op3_pii
from quillgrid.llm.quality import op6_quality_pu
from quillgrid.llm.repair import op11_conversation_repair
from quillgrid.llm.secrets import OP1_SQL, op1_secret_scan
from quillgrid.llm.tokens import op5_token_counts
from quillgrid.llm.urls import OP7_SQL, op7_url_filters
from quillgrid.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ann_partitions": op2_ann_partitions,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_quality_pu": op6_quality_pu,
    "op7_url_filters": op7_url_filters,
    "op8_mix_sources": op8_mix_sources,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_chat_format": op10_chat_format,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_bpe_codec": op13_bpe_codec,
}

SQL: dict[str, str] = {
    "op1_secret_scan": OP1_SQL,
    "op7_url_filters": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op9_ngram_jaccard": OP9_SQL,
    "op10_chat_format": OP10_SQL,
}
