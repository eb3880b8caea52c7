"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from .bpe import op1_bpe
from .decontamination import OP13_SQL, op13_decontamination
from .fertility import op9_fertility
from .line_dedup import op5_line_dedup
from .near_vectors import op2_near_vectors
from .ngram_join import op4_ngram_join
from .packing import op10_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import op3_quality
from .shards import OP6_SQL, op6_shards
from .token_counts import op7_token_counts
from .turn_repair import op12_turn_repair
from .url_filter import OP8_SQL, op8_url_filter

QUERIES = {f.__name__: f for f in (op1_bpe, op2_near_vectors, op3_quality, op4_ngram_join, op5_line_dedup, op6_shards, op7_token_counts, op8_url_filter, op9_fertility, op10_packing, op11_prefix_trie, op12_turn_repair, op13_decontamination)}
ORACLE_SQL = {"op6_shards": OP6_SQL, "op8_url_filter": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_decontamination": OP13_SQL}
