"""Schemas and constants of the signal audit."""

from __future__ import annotations

#: Features by family, in plan order, and the families of each dataset (fixed values).
FAMILIES = {
    "hrv": ("hrv_mean_nn", "hrv_sdnn", "hrv_rmssd", "hrv_pnn50", "hrv_mean_hr", "hrv_lf", "hrv_hf", "hrv_lf_hf"),
    "eda": ("eda_tonic_mean", "eda_tonic_std", "eda_phasic_std", "eda_scr_count", "eda_scr_amp_mean", "eda_level_mean", "eda_level_std"),
    "resp": ("resp_rate_mean", "resp_rate_std", "resp_amp_mean"),
}
PLAN = {"wesad": ("hrv", "eda", "resp"), "cogwear": ("hrv", "eda"), "maus": ("hrv",)}
#: The null rungs and the descriptive one.
NULL_RUNGS = ("gaussian", "iaaft", "subject_perm_broken", "flatline", "deleted")
RUNGS = (*NULL_RUNGS, "subject_perm_preserved")

SEGMENTS = "recording string, seg_id bigint, start_s double, end_s double, label int, seg_name string"
SCORED = "subject string, window_id string, y int, yhat int, failure boolean, logprob_a double, logprob_b double"


def feature_columns(dataset: str) -> list[str]:
    """The feature block of a dataset, in plan order."""
    return [c for family in PLAN[dataset] for c in FAMILIES[family]]


def require_columns(df, columns) -> None:
    """Raise if a column is missing; more columns are allowed."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
