"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import oracles
from .bpe import op6_bpe
from .decontam import op9_decontamination
from .jaccard import op5_jaccard
from .licenses import op1_licenses
from .pii import op8_pii
from .quality_model import op10_quality_model
from .quality_rules import op4_quality_rules
from .secrets import op7_secrets
from .toxicity import op3_toxicity
from .urls import op2_urls


def queries() -> dict:
    return {
        "op1_licenses": op1_licenses,
        "op2_urls": op2_urls,
        "op3_toxicity": op3_toxicity,
        "op4_quality_rules": op4_quality_rules,
        "op5_jaccard": op5_jaccard,
        "op6_bpe": op6_bpe,
        "op7_secrets": op7_secrets,
        "op8_pii": op8_pii,
        "op9_decontamination": op9_decontamination,
        "op10_quality_model": op10_quality_model,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_urls": oracles.URLS, "op5_jaccard": oracles.JACCARD, "op9_decontamination": oracles.DECONTAMINATION}
