"""The queries of this subpackage and their DuckDB SQL."""

from .conversation_repair import op11_repair_conversations
from .decontamination import OP1_SQL, op1_decontaminate
from .divergence import OP13_SQL, op13_divergence_audit
from .jaccard_join import op6_jaccard_join
from .language_id import op5_language_id
from .license_scan import op2_license_scan
from .mixing import OP12_SQL, op12_mix_sources
from .packing import op4_pack
from .sentence_spans import OP9_SQL, op9_sentence_spans
from .sharding import op8_shard_bytes
from .suffix_dedup import op3_suffix_dedup
from .token_counts import op7_token_counts
from .webp import op10_webp

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pack": op4_pack,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_counts": op7_token_counts,
    "op8_shard_bytes": op8_shard_bytes,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_webp": op10_webp,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_mix_sources": op12_mix_sources,
    "op13_divergence_audit": op13_divergence_audit,
}
ORACLE_SQL = {
    "op1_decontaminate": OP1_SQL, "op9_sentence_spans": OP9_SQL, "op12_mix_sources": OP12_SQL, "op13_divergence_audit": OP13_SQL
}
