"""Canonical event contract: fields, types and roles."""

from __future__ import annotations

# Required canonical fields and their types.
REQUIRED = {
    "case_id": "string", "event_index": "integer", "timestamp": "datetime", "raw_activity": "string",
    "lifecycle": "string", "raw_activity_token": "string", "next_activity_raw": "string", "resource": "string",
    "time_delta": "float", "time_since_previous": "float", "weekday_sin": "float", "weekday_cos": "float",
    "hour_sin": "float", "hour_cos": "float", "remaining_time": "float", "outcome": "integer",
    "dataset_id": "string", "client_id": "string", "split": "string", "requested_amount_value": "float",
    "requested_amount_mask": "integer", "loan_goal": "string", "loan_goal_mask": "integer",
    "application_type": "string", "application_type_mask": "integer", "offer_present": "integer",
    "offer_feature_mask": "integer", "credit_score_value": "float", "monthly_cost_value": "float",
    "offered_amount_value": "float", "number_of_terms_value": "float",
}
# Offer state fields, and fields derived rather than mapped.
OFFER_FIELDS = ("credit_score_value", "monthly_cost_value", "offered_amount_value", "number_of_terms_value")
CYCLIC_FIELDS = ("weekday_sin", "weekday_cos", "hour_sin", "hour_cos")
DERIVED = (
    "dataset_id", "client_id", "split", "event_index", "time_since_previous", *CYCLIC_FIELDS,
    "offer_present", "offer_feature_mask",
)
SPARK_TYPES = {"string": "string", "integer": "long", "float": "double", "datetime": "timestamp"}
