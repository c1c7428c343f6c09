"""Label vocabulary and code -> sub-code hierarchy.

The lists below are fixed values: labels must equal the ones used by the
annotation guideline byte for byte, otherwise metrics and confusion tables
silently drop them.  They are kept in their natural order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: code vocabulary (8) --------------------------------------
CODE_SET = [
    "CareCoordinationPatient",
    "CareCoordinationProvider",
    "PartnershipPatient",
    "PartnershipProvider",
    "SDOH",
    "SharedDecisionPatient",
    "SharedDecisionProvider",
    "SocioEmotionalBehaviour",
]

# ---- fixed values: sub-code vocabulary (26) ---------------------------------
SUB_CODE_SET = [
    "Appreciation/Gratitude",
    "Approval/Reinforcement",
    "ApprovalofDecision/Reinforcement",
    "Clinical Care",
    "EconomicStability",
    "EducationAccessAndQuality",
    "ExploreOptions",
    "HealthCareAccessAndQuality",
    "MakeDecision",
    "NeighborhoodAndBuiltEnvironment",
    "SeekingApproval",
    "ShareOptions",
    "SocialAndCommunityContext",
    "acknowledgePatientExpertiseKnowledge",
    "activeParticipation/involvement",
    "alignment",
    "build trust",
    "checkingUnderstanding/clarification",
    "connection",
    "expressOpinions",
    "inviteCollabration",
    "maintainCommunication",
    "requestsForOpinion",
    "salutation",
    "signoff",
    "statePreferences",
]

# ---- fixed values: valid (code, sub-code) pairs, 36 in total ----------------
# Note "Clinical care" (patient side) vs "Clinical Care" (provider side) and
# the literal "None" sub-codes: both are kept exactly as the guideline has them.
CODE_SUBCODES: dict[str, list[str]] = {
    "CareCoordinationPatient": ["None"],
    "CareCoordinationProvider": ["None"],
    "PartnershipPatient": [
        "Appreciation/Gratitude",
        "Clinical care",
        "activeParticipation/involvement",
        "alignment",
        "build trust",
        "connection",
        "expressOpinions",
        "salutation",
        "signoff",
        "statePreferences",
    ],
    "PartnershipProvider": [
        "Appreciation/Gratitude",
        "Clinical Care",
        "acknowledgePatientExpertiseKnowledge",
        "alignment",
        "build trust",
        "checkingUnderstanding/clarification",
        "connection",
        "inviteCollabration",
        "maintainCommunication",
        "requestsForOpinion",
        "salutation",
        "signoff",
    ],
    "SDOH": [
        "EconomicStability",
        "EducationAccessAndQuality",
        "HealthCareAccessAndQuality",
        "NeighborhoodAndBuiltEnvironment",
        "SocialAndCommunityContext",
    ],
    "SharedDecisionPatient": [
        "ApprovalofDecision/Reinforcement",
        "ExploreOptions",
        "SeekingApproval",
    ],
    "SharedDecisionProvider": [
        "Approval/Reinforcement",
        "MakeDecision",
        "ShareOptions",
    ],
    "SocioEmotionalBehaviour": ["None"],
}

# ---- fixed values: fallback labels used by the negative generator -----------
FALLBACK_SUB_CODE = "Generalinformation"
FALLBACK_CODE = "InfoGive"
NONE_TOKEN = "__NONE__"


def norm_label_py(s: str) -> str:
    """Driver-side twin of :func:`spanpref.functions.labels.norm_label` (constants only)."""
    return re.sub(r"\s+", " ", s.strip()).lower()


def canon_pairs(allowed: list[str]) -> list[tuple[str, str]]:
    """norm -> canonical; with duplicates under one key the last one wins."""
    m: dict[str, str] = {}
    for lab in allowed:
        if isinstance(lab, str):
            m[norm_label_py(lab)] = lab
    return list(m.items())


def hierarchy_pairs() -> list[tuple[str, str]]:
    """All valid (code, sub_code) pairs ordered by (code, sub_code)."""
    return sorted((c, s) for c, subs in CODE_SUBCODES.items() for s in subs)


def _map_literal(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def code_canon_map() -> Column:
    return _map_literal(canon_pairs(CODE_SET))


def sub_canon_map() -> Column:
    return _map_literal(canon_pairs(SUB_CODE_SET))


def hierarchy_map() -> Column:
    """MAP<code, ARRAY<sub_code>> literal (8 keys)."""
    return F.create_map(
        *[x for c, subs in CODE_SUBCODES.items() for x in (F.lit(c), F.array(*[F.lit(s) for s in subs]))]
    )


def valid_subs(code: Column) -> Column:
    """Valid sub-codes of ``code``; empty array for a code outside the hierarchy."""
    return F.coalesce(F.try_element_at(hierarchy_map(), code), F.array().cast("array<string>"))


def subs_or_fallback(code: Column) -> Column:
    """``CODE_SUBCODES.get(code, ["Generalinformation"])``."""
    return F.coalesce(F.try_element_at(hierarchy_map(), code), F.array(F.lit(FALLBACK_SUB_CODE)))


def is_valid_pair(code: Column, sub_code: Column) -> Column:
    """Membership of (code, sub_code) in the hierarchy."""
    return F.coalesce(F.array_contains(valid_subs(code), sub_code), F.lit(False))


def code_vocab_array() -> Column:
    return F.array(*[F.lit(c) for c in CODE_SET])


def sub_vocab_array() -> Column:
    return F.array(*[F.lit(c) for c in SUB_CODE_SET])


def hierarchy_pairs_array() -> Column:
    """ARRAY<STRUCT<code, sub_code>> of the 36 pairs ordered by (code, sub_code)."""
    return F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("sub_code")) for c, s in hierarchy_pairs()])


def label_vocab_df(spark: SparkSession) -> DataFrame:
    """D4/D6 as a dimension table ``(kind, label, norm_label)``."""
    rows = [("code", lab, norm_label_py(lab)) for lab in CODE_SET] + [
        ("sub_code", lab, norm_label_py(lab)) for lab in SUB_CODE_SET
    ]
    return spark.createDataFrame(rows, "kind string, label string, norm_label string")


def label_hierarchy_df(spark: SparkSession) -> DataFrame:
    """D5 as a dimension table ``(code, sub_code, ord)``."""
    rows = [(c, s, i) for c, subs in CODE_SUBCODES.items() for i, s in enumerate(subs)]
    return spark.createDataFrame(rows, "code string, sub_code string, ord int")
