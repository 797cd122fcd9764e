"""Queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from .decontaminate import OP5_SQL, op5_decontamination
from .jaccard_join import op1_jaccard_join
from .line_dedup import OP4_SQL, op4_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .packing import op3_packing
from .passage_dedup import OP13_SQL, op13_passage_dedup
from .quality_crf import op9_quality_classifier
from .quality_rules import op7_quality_rules
from .ranked_search import OP12_SQL, op12_ranked_search
from .sharding import op2_sharding
from .substring_dedup import op8_substring_dedup
from .token_files import op6_token_files
from .warc import OP10_SQL, op10_warc


def queries() -> dict:
    return {
        "op10_warc": op10_warc,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_ranked_search": op12_ranked_search,
        "op13_passage_dedup": op13_passage_dedup,
        "op1_jaccard_join": op1_jaccard_join,
        "op2_sharding": op2_sharding,
        "op3_packing": op3_packing,
        "op4_line_dedup": op4_line_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_token_files": op6_token_files,
        "op7_quality_rules": op7_quality_rules,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality_classifier": op9_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_passage_dedup": OP13_SQL, "op4_line_dedup": OP4_SQL, "op5_decontamination": OP5_SQL}
