"""Registry of the operator queries of this subpackage and of their SQL."""

from . import centroid_clustering as _clustering
from . import decontaminate as _decontaminate
from . import exact_topk as _topk
from . import language_id as _language_id
from . import lm_score as _lm
from . import pii as _pii
from . import quality as _quality
from . import sentencepiece_codec as _sentencepiece
from . import simhash as _simhash
from . import substring_dedup as _substring
from . import token_alignment as _alignment
from . import tool_calls as _tools
from . import url_filter as _urls


def queries() -> dict:
    return {
        "op1_language_id": _language_id.op1_language_id,
        "op2_url_filter": _urls.op2_url_filter,
        "op3_sentencepiece": _sentencepiece.op3_sentencepiece,
        "op4_lm_score": _lm.op4_lm_score,
        "op5_quality": _quality.op5_quality,
        "op6_decontaminate": _decontaminate.op6_decontaminate,
        "op7_substring_dedup": _substring.op7_substring_dedup,
        "op8_simhash": _simhash.op8_simhash,
        "op9_pii": _pii.op9_pii,
        "op10_tool_calls": _tools.op10_tool_calls,
        "op11_centroid_clustering": _clustering.op11_centroid_clustering,
        "op12_token_alignment": _alignment.op12_token_alignment,
        "op13_exact_topk": _topk.op13_exact_topk,
    }


def oracle_sql() -> dict:
    return {
        "op4_lm_score": _lm.OP4_SQL,
        "op6_decontaminate": _decontaminate.OP6_SQL,
        "op7_substring_dedup": _substring.OP7_SQL,
        "op11_centroid_clustering": _clustering.OP11_SQL,
        "op12_token_alignment": _alignment.op12_token_alignment,
        "op13_exact_topk": _topk.OP13_SQL,
    }
