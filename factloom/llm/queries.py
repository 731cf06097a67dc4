"""The registered queries of this subpackage."""

from __future__ import annotations

from . import license_scan, mtree, near_dedup, parts, sharding
from .license_scan import op4_minhash_license_scan
from .lm_scoring import op8_attention_lm_scoring
from .mixing import op10_cube_mixing
from .mtree import op1_mtree_topk
from .near_dedup import op6_minmax_near_dedup
from .packing import op2_hierarchical_packing
from .quality import op3_rff_quality
from .quality_rules import op9_js_quality_rules
from .sharding import op5_extendible_sharding
from .toxicity import op7_levenshtein_toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = [op1_mtree_topk, op2_hierarchical_packing, op3_rff_quality, op4_minhash_license_scan, op5_extendible_sharding, op6_minmax_near_dedup, op7_levenshtein_toxicity, op8_attention_lm_scoring, op9_js_quality_rules, op10_cube_mixing]
    return {f.__name__: f for f in found} | {"pipeline": _pipeline} | parts.queries()


def oracle_sql():
    return {"op1_mtree_topk": mtree.ORACLE, "op4_minhash_license_scan": license_scan.oracle(), "op5_extendible_sharding": sharding.oracle(), "op6_minmax_near_dedup": near_dedup.ORACLE} | parts.oracle_sql()
