"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from sparkwell.llm.conversation_repair import op13_conversation_repair
from sparkwell.llm.jaccard_join import op7_jaccard_join
from sparkwell.llm.jpeg import op2_media_jpeg
from sparkwell.llm.language_id import op8_language_id
from sparkwell.llm.line_dedup import OP6_SQL, op6_line_dedup
from sparkwell.llm.merkle import OP12_SQL, op12_merkle_manifest
from sparkwell.llm.packing import op4_best_fit_packing
from sparkwell.llm.quality_classifier import op9_quality_classifier
from sparkwell.llm.quality_rules import op5_quality_rules
from sparkwell.llm.secret_scan import op11_secret_scan
from sparkwell.llm.sentencepiece_lattice import op10_sentencepiece
from sparkwell.llm.token_counts import op1_token_counts
from sparkwell.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": op1_token_counts,
    "op2_media_jpeg": op2_media_jpeg,
    "op3_warc": op3_warc,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_secret_scan": op11_secret_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE = {"op3_warc": OP3_SQL, "op6_line_dedup": OP6_SQL, "op12_merkle_manifest": OP12_SQL}
