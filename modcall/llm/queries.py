"""The queries of this subpackage and their DuckDB SQL, by the names they are registered under."""

from .bpe import op2_bpe_encode_decode
from .embedding_dedup import op3_embedding_near_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op7_language_id
from .line_dedup import OP10_SQL, op10_line_dedup
from .packing import op8_best_fit_packing
from .quality_rules import op9_quality_rules
from .simhash import op6_simhash_near_dedup
from .spelling import OP11_SQL, op11_spelling_variants
from .substring_dedup import op1_substring_dedup
from .token_counts import op5_token_counts
from .vantage import OP13_SQL, op13_nearest_neighbours
from .warc import OP4_SQL, op4_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_bpe_encode_decode,
        op3_embedding_near_dedup,
        op4_warc,
        op5_token_counts,
        op6_simhash_near_dedup,
        op7_language_id,
        op8_best_fit_packing,
        op9_quality_rules,
        op10_line_dedup,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_nearest_neighbours,
    )
}

#: The others are tested against brute force, exact round trips or held-out labels.
ORACLE_SQL = {"op4_warc": OP4_SQL, "op10_line_dedup": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_nearest_neighbours": OP13_SQL}
