"""The queries of the corpus operators and the SQL that checks them."""

from servicelens.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from servicelens.llm.html_text import op8_main_text
from servicelens.llm.language_id import op5_language_id
from servicelens.llm.license_scan import OP13_SQL, op13_license_scan
from servicelens.llm.line_dedup import OP1_SQL, op1_line_dedup
from servicelens.llm.merkle import OP11_SQL, op11_merkle_manifest
from servicelens.llm.nearest import OP2_SQL, op2_nearest
from servicelens.llm.packing import op9_pack_documents
from servicelens.llm.secret_scan import OP4_SQL, op4_secret_scan
from servicelens.llm.sentencepieces import op7_sentencepiece
from servicelens.llm.simhash import op3_simhash
from servicelens.llm.token_counts import op6_token_counts
from servicelens.llm.topk import OP10_SQL, op10_top_k

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_nearest": op2_nearest,
    "op3_simhash": op3_simhash,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_main_text": op8_main_text,
    "op9_pack_documents": op9_pack_documents,
    "op10_top_k": op10_top_k,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_license_scan": op13_license_scan,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_nearest": OP2_SQL,
    "op4_secret_scan": OP4_SQL,
    "op10_top_k": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_license_scan": OP13_SQL,
}
