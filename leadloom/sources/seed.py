"""The seed rows as typed rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of the three scores.
WEBSITE_QUALITY = {"conversion": 25, "mobile": 20, "content": 15, "trust": 15, "technical": 15, "design_ux": 10}
BUSINESS_OPPORTUNITY = {"viability": 25, "demand": 25, "ability_to_pay": 20, "contactability": 20, "icp_fit": 10}
LEAD_PRIORITY = {"website_quality": 0.45, "business_opportunity": 0.4, "market_fit": 0.15}

# Key, value, type, whether it is a feature flag, description.
SETTINGS: list[tuple[str, object, str, bool, str]] = [
    ("target.industries", ["plumbing"], "array", False, "Industries the platform targets for website-sales outreach."),
    ("target.states", [], "array", False, "US states (2-letter) the platform operates in. Empty = set from Settings before enabling outreach."),
    ("target.cities", [], "array", False, "Cities targeted for discovery. Empty = set from Settings before enabling discovery."),
    ("scoring.website_quality.weights", WEBSITE_QUALITY, "json", False, "Category weights (must sum to 100) for the website quality score."),
    ("scoring.business_opportunity.weights", BUSINESS_OPPORTUNITY, "json", False, "Category weights (must sum to 100) for the business opportunity score."),
    (
        "scoring.lead_priority.formula", LEAD_PRIORITY, "json", False,
        "Lead priority formula weights. lead_priority = (100 - website_quality)*0.45 + business_opportunity*0.40 + market_fit*0.15.",
    ),
    (
        "scoring.lead_classification.thresholds", {"high_priority_min": 80, "secondary_min": 65, "review_min": 50}, "json", False,
        "Priority-score thresholds: >=80 HIGH_PRIORITY, >=65 SECONDARY, >=50 REVIEW, <50 REJECT.",
    ),
    ("outreach.followup.day_offsets", [3, 7], "array", False, "Follow-up sequence timing in days after the previous message (steps 1, 2)."),
    ("outreach.email.daily_limit", {"outreach": 20, "followup": 25, "max_per_contact": 1}, "json", False, "Daily email sending limits for outreach and follow-ups."),
    ("pricing.website_setup_fee_cents", 150000, "number", False, "One-time website build setup fee, in cents (default $1,500)."),
    ("pricing.hosting_monthly_cents", 2900, "number", False, "Recurring hosting/maintenance fee per month, in cents (default $29)."),
    (
        "notifications.rules", {"buying_intent": True, "critical_exceptions": True, "high_exceptions": True, "digest": "daily"}, "json", False,
        "Which events notify the owner. Buying intent + exceptions only by default.",
    ),
    (
        "business.hours", {"timezone": "America/Chicago", "workdays": [1, 2, 3, 4, 5], "start": "09:00", "end": "17:00"}, "json", False,
        "Operating hours used to schedule outreach (ISO weekday numbers, 24h times).",
    ),
    ("flags.demo_generation_enabled", False, "boolean", True, "Feature flag: demo generation pipeline (later brief)."),
    ("flags.outreach_enabled", False, "boolean", True, "Feature flag: outreach + follow-up sending (later brief; requires EMAIL_API_KEY)."),
    ("flags.production_pipeline_enabled", False, "boolean", True, "Feature flag: production website generation/deploy (later brief)."),
    ("flags.billing_enabled", False, "boolean", True, "Feature flag: billing/subscriptions (later brief; platform not yet live)."),
]
# Score type, version, weights, whether it is active, description.
VERSIONS: list[tuple[str, int, dict, bool, str]] = [
    ("WEBSITE_QUALITY", 1, WEBSITE_QUALITY, True, "Website quality: weighted deterministic checks, 0-100."),
    ("BUSINESS_OPPORTUNITY", 1, BUSINESS_OPPORTUNITY, True, "Business opportunity: configurable category weights, 0-100."),
    ("LEAD_PRIORITY", 1, LEAD_PRIORITY, True, "Lead priority = (100-wsq)*0.45 + bos*0.40 + market_fit*0.15, 0-100."),
]


def settings(spark: SparkSession) -> DataFrame:
    """(key, value as JSON, type, is_feature_flag, description)."""
    rows = [(k, json.dumps(v), t, f, d) for k, v, t, f, d in SETTINGS]
    return as_variant(spark.createDataFrame(rows, "key string, value string, type string, is_feature_flag boolean, description string"), "value")


def setting(settings: DataFrame, key: str) -> object:
    """The value of one setting, read from its row."""
    found = settings.where(F.col("key") == key).select(F.to_json("value").alias("value")).first()
    if found is None:
        raise KeyError(key)
    return json.loads(found["value"])


def scoring_versions(spark: SparkSession) -> DataFrame:
    """(score_type, version, weights as a map, is_active, description)."""
    rows = [(t, v, {k: float(x) for k, x in w.items()}, a, d) for t, v, w, a, d in VERSIONS]
    return spark.createDataFrame(rows, "score_type string, version int, weights map<string,double>, is_active boolean, description string")


def as_variant(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.parse_json(column))
