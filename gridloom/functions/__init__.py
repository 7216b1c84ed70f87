"""Column functions: expressions for any DataFrame, without a plan of their own."""

from gridloom.operators.audit import band_role
from gridloom.operators.features import eigenvalues
from gridloom.operators.gate import escalation
from gridloom.operators.metric import tversky_score
from gridloom.operators.threshold import binary_threshold, calibrated, soft_remap

__all__ = ["band_role", "binary_threshold", "calibrated", "eigenvalues", "escalation", "soft_remap", "tversky_score"]
