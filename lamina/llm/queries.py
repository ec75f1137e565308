"""The registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from .divergence import OP13_SQL, op13_source_divergence
from .lexical import OP12_SQL, op12_lexical_search
from .media import op1_media
from .mixing import OP6_SQL, op6_mixing
from .neardup import op10_near_duplicates
from .ngram_lm import op5_ngram_scores
from .packing import op2_best_fit
from .pii import op4_pii
from .quality import op8_quality
from .secrets import op9_secrets
from .token_files import op3_token_files
from .topk import OP7_SQL, op7_top_k
from .url_rules import OP11_SQL, op11_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_media, op2_best_fit, op3_token_files, op4_pii, op5_ngram_scores, op6_mixing, op7_top_k, op8_quality, op9_secrets, op10_near_duplicates,
        op11_url_filter, op12_lexical_search, op13_source_divergence,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_mixing": OP6_SQL, "op7_top_k": OP7_SQL, "op11_url_filter": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_source_divergence": OP13_SQL}
