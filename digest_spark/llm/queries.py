"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from digest_spark.llm.audit import OP13_SQL, op13_filter_audit
from digest_spark.llm.bpe import op7_bpe_round_trip
from digest_spark.llm.decontamination import OP5_SQL, op5_decontamination
from digest_spark.llm.language import op3_language
from digest_spark.llm.line_dedup import op8_line_dedup
from digest_spark.llm.quality import op11_quality
from digest_spark.llm.sharding import op1_sharding
from digest_spark.llm.simhash import op2_simhash
from digest_spark.llm.substring_dedup import op4_substring_dedup
from digest_spark.llm.token_counts import op6_token_counts
from digest_spark.llm.topk import OP9_SQL, op9_topk
from digest_spark.llm.toxicity import op10_toxicity
from digest_spark.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_line_dedup": op8_line_dedup,
    "op9_topk": op9_topk,
    "op10_toxicity": op10_toxicity,
    "op11_quality": op11_quality,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op5_decontamination": OP5_SQL,
    "op9_topk": OP9_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
