"""What the catalog queries must give, written out: the SQL side of the comparison knows nothing of the registry."""

from __future__ import annotations

# All tables.
TABLES = """
audit_logs businesses contacts conversation_messages conversations customer_onboarding customers demos domains exceptions followups lead_scores
lead_state_history metrics outreach_campaigns outreach_messages payments production_websites sales_opportunities scoring_versions subscriptions
system_settings tasks templates website_analyses website_versions websites
""".split()

# Enums and how many values each has.
ENUMS = """
audit_actor_type=4 business_operational_status=5 campaign_status=4 contact_status=3
conversation_status=3 customer_status=3 demo_status=5 domain_status=5
exception_priority=4 exception_status=4 followup_status=4 lead_classification=4
lead_lifecycle_state=22 message_direction=2 message_status=9 onboarding_status=4
opportunity_status=3 payment_status=4 production_website_status=7 reply_classification=5
scoring_type=3 subscription_interval=2 subscription_status=4 task_status=5
template_type=2 website_classification=6 website_status=5 website_version_status=4
""".split()

# Indexes by table, those of keys and unique constraints included.
INDEXES = """
audit_logs: audit_logs_pkey idx_audit_logs_entity idx_audit_logs_created_at
businesses: businesses_pkey idx_businesses_lifecycle_state idx_businesses_state_city idx_businesses_city_state_zip idx_businesses_source idx_businesses_industry idx_businesses_zip
contacts: contacts_pkey idx_contacts_business_id idx_contacts_email idx_contacts_status
conversation_messages: conversation_messages_pkey idx_conversation_messages_conversation_id
conversations: conversations_pkey idx_conversations_business_id idx_conversations_status
customer_onboarding: customer_onboarding_pkey idx_customer_onboarding_status u_customer_onboarding_customer_id
customers: customers_pkey u_customers_business_id
demos: demos_pkey idx_demos_business_id idx_demos_status idx_demos_template_id
domains: domains_pkey idx_domains_customer_id idx_domains_status u_domains_name
exceptions: exceptions_pkey idx_exceptions_status_priority idx_exceptions_entity idx_exceptions_first_seen_at
followups: followups_pkey idx_followups_outreach_message_id idx_followups_status_scheduled_at
lead_scores: lead_scores_pkey idx_lead_scores_business_id idx_lead_scores_created_at idx_lead_scores_classification idx_lead_scores_priority
lead_state_history: lead_state_history_pkey idx_lead_state_history_business_id idx_lead_state_history_business_created
metrics: metrics_pkey u_metrics_date_name_dim
outreach_campaigns: outreach_campaigns_pkey idx_outreach_campaigns_status
outreach_messages: outreach_messages_pkey idx_outreach_messages_business_id idx_outreach_messages_campaign_id idx_outreach_messages_status idx_outreach_messages_contact_id
payments: payments_pkey idx_payments_customer_id idx_payments_status u_payments_external_ref
production_websites: production_websites_pkey idx_production_websites_customer_id
sales_opportunities: sales_opportunities_pkey idx_sales_opportunities_status idx_sales_opportunities_business_id idx_sales_opportunities_customer_id
scoring_versions: scoring_versions_pkey idx_scoring_versions_active u_scoring_versions_type_version
subscriptions: subscriptions_pkey idx_subscriptions_customer_id idx_subscriptions_status
system_settings: system_settings_pkey
tasks: tasks_pkey idx_tasks_status_scheduled_at idx_tasks_entity idx_tasks_type
templates: templates_pkey u_templates_type_name_version
website_analyses: website_analyses_pkey idx_website_analyses_website_id idx_website_analyses_analyzed_at
website_versions: website_versions_pkey idx_website_versions_production_website_id u_website_versions_site_number
websites: websites_pkey idx_websites_business_id idx_websites_status u_websites_url
"""

# Constraints by kind: p primary key, u unique, c check, f foreign key (names end at 63 characters).
CONSTRAINTS = {
    "p": """
        audit_logs_pkey businesses_pkey contacts_pkey conversation_messages_pkey conversations_pkey customer_onboarding_pkey customers_pkey demos_pkey
        domains_pkey exceptions_pkey followups_pkey lead_scores_pkey lead_state_history_pkey metrics_pkey outreach_campaigns_pkey
        outreach_messages_pkey payments_pkey production_websites_pkey sales_opportunities_pkey scoring_versions_pkey subscriptions_pkey
        system_settings_pkey tasks_pkey templates_pkey website_analyses_pkey website_versions_pkey websites_pkey
    """.split(),
    "u": """
        u_customer_onboarding_customer_id u_customers_business_id u_domains_name u_metrics_date_name_dim u_payments_external_ref
        u_scoring_versions_type_version u_templates_type_name_version u_website_versions_site_number u_websites_url
    """.split(),
    "c": """
        chk_businesses_contactability chk_businesses_rating chk_contacts_contactability chk_conversation_messages_conf chk_lead_scores_bos
        chk_lead_scores_market_fit chk_lead_scores_priority chk_lead_scores_wsq chk_outreach_campaigns_daily_limit chk_payments_amount
        chk_subscriptions_amount chk_system_settings_type chk_website_analyses_score
    """.split(),
    "f": """
        contacts_business_id_businesses_id_fk conversation_messages_conversation_id_conversations_id_fk conversations_business_id_businesses_id_fk
        conversations_contact_id_contacts_id_fk customer_onboarding_customer_id_customers_id_fk customers_business_id_businesses_id_fk
        demos_business_id_businesses_id_fk demos_template_id_templates_id_fk domains_customer_id_customers_id_fk
        followups_outreach_message_id_outreach_messages_id_fk lead_scores_business_id_businesses_id_fk
        lead_scores_scoring_version_scoring_versions_id_fk lead_state_history_business_id_businesses_id_fk
        outreach_campaigns_email_template_id_templates_id_fk outreach_messages_business_id_businesses_id_fk
        outreach_messages_campaign_id_outreach_campaigns_id_fk outreach_messages_contact_id_contacts_id_fk payments_customer_id_customers_id_fk
        payments_subscription_id_subscriptions_id_fk production_websites_customer_id_customers_id_fk production_websites_domain_id_domains_id_fk
        sales_opportunities_business_id_businesses_id_fk sales_opportunities_customer_id_customers_id_fk
        sales_opportunities_source_lead_id_businesses_id_fk subscriptions_customer_id_customers_id_fk website_analyses_website_id_websites_id_fk
        website_analyses_analysis_version_scoring_versions_id_fk website_versions_production_website_id_production_websites_id_f
        websites_business_id_businesses_id_fk
    """.split(),
}

# Keys of the settings that are feature flags.
FLAGS = "flags.demo_generation_enabled flags.outreach_enabled flags.production_pipeline_enabled flags.billing_enabled".split()

# Settings as (key, type, text of the value), by key.
SETTINGS = [
    ("business.hours", "json", '{"end":"17:00","start":"09:00","timezone":"America/Chicago","workdays":[1,2,3,4,5]}'),
    ("flags.billing_enabled", "boolean", "false"),
    ("flags.demo_generation_enabled", "boolean", "false"),
    ("flags.outreach_enabled", "boolean", "false"),
    ("flags.production_pipeline_enabled", "boolean", "false"),
    ("notifications.rules", "json", '{"buying_intent":true,"critical_exceptions":true,"digest":"daily","high_exceptions":true}'),
    ("outreach.email.daily_limit", "json", '{"followup":25,"max_per_contact":1,"outreach":20}'),
    ("outreach.followup.day_offsets", "array", "[3,7]"),
    ("pricing.hosting_monthly_cents", "number", "2900"),
    ("pricing.website_setup_fee_cents", "number", "150000"),
    ("scoring.business_opportunity.weights", "json", '{"ability_to_pay":20,"contactability":20,"demand":25,"icp_fit":10,"viability":25}'),
    ("scoring.lead_classification.thresholds", "json", '{"high_priority_min":80,"review_min":50,"secondary_min":65}'),
    ("scoring.lead_priority.formula", "json", '{"business_opportunity":0.4,"market_fit":0.15,"website_quality":0.45}'),
    ("scoring.website_quality.weights", "json", '{"content":15,"conversion":25,"design_ux":10,"mobile":20,"technical":15,"trust":15}'),
    ("target.cities", "array", "[]"),
    ("target.industries", "array", '["plumbing"]'),
    ("target.states", "array", "[]"),
]

# What the verification looks up besides tables and enums.
CHECKED_INDEXES = """
idx_businesses_lifecycle_state idx_businesses_state_city idx_businesses_source idx_outreach_messages_campaign_id idx_outreach_messages_status
idx_followups_status_scheduled_at idx_audit_logs_entity idx_audit_logs_created_at idx_tasks_status_scheduled_at idx_exceptions_status_priority
idx_website_analyses_analyzed_at idx_lead_scores_priority idx_lead_scores_classification
""".split()
CHECKED_CONSTRAINTS = """
contacts_business_id_businesses_id_fk lead_scores_scoring_version_scoring_versions_id_fk website_analyses_analysis_version_scoring_versions_id_fk
outreach_messages_campaign_id_outreach_campaigns_id_fk followups_outreach_message_id_outreach_messages_id_fk u_websites_url u_metrics_date_name_dim
u_customers_business_id u_scoring_versions_type_version u_website_versions_site_number
""".split()
CHECKED_CHECKS = """
chk_businesses_contactability chk_lead_scores_wsq chk_lead_scores_bos chk_lead_scores_priority
""".split()
