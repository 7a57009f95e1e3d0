"""The relational model: enums, tables, keys, checks and indexes, each stated once."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

from pyspark.sql.types import (
    BooleanType, DataType, DateType, DecimalType, IntegerType, StringType, StructField, StructType, TimestampType, VariantType,
)

# Enum names and their values in sort order.
ENUMS: dict[str, tuple[str, ...]] = {
    name: tuple(values.split())
    for name, values in {
        "audit_actor_type": "SYSTEM USER API JOB",
        "business_operational_status": "OPERATIONAL CLOSED PERMANENTLY_CLOSED TEMPORARILY_CLOSED UNKNOWN",
        "campaign_status": "DRAFT ACTIVE PAUSED COMPLETED",
        "contact_status": "ACTIVE INVALID SUPPRESSED",
        "conversation_status": "OPEN HANDLED CLOSED",
        "customer_status": "ACTIVE PAST_DUE CANCELLED",
        "demo_status": "GENERATING READY QA_FAILED DEPLOYED EXPIRED",
        "domain_status": "AVAILABLE REGISTERED IN_USE EXPIRED FAILED",
        "exception_priority": "CRITICAL HIGH MEDIUM LOW",
        "exception_status": "OPEN ACKNOWLEDGED RESOLVED IGNORED",
        "followup_status": "PENDING SENT FAILED SKIPPED",
        "lead_classification": "HIGH_PRIORITY SECONDARY REVIEW REJECT",
        "lead_lifecycle_state": "DISCOVERED ENRICHING ENRICHED ANALYZING ANALYZED QUALIFIED REJECTED DEMO_GENERATING DEMO_READY OUTREACH_PENDING CONTACTED"
        " FOLLOWUP_1 FOLLOWUP_2 RESPONDED NURTURE INTERESTED HOT SALES_HANDOFF WON LOST DO_NOT_CONTACT CUSTOMER",
        "message_direction": "INBOUND OUTBOUND",
        "message_status": "PENDING SENT BOUNCED COMPLAINED OPENED CLICKED REPLIED OPTED_OUT FAILED",
        "onboarding_status": "PENDING SEND_REQUESTED REQUESTED COMPLETE",
        "opportunity_status": "OPEN WON LOST",
        "payment_status": "PENDING SUCCEEDED FAILED REFUNDED",
        "production_website_status": "ONBOARDING_COMPLETE CONTENT_GENERATION WEBSITE_GENERATION QA CUSTOMER_REVIEW DEPLOYMENT LIVE",
        "reply_classification": "INTERESTED NEEDS_INFO NOT_INTERESTED OPT_OUT OTHER",
        "scoring_type": "WEBSITE_QUALITY BUSINESS_OPPORTUNITY LEAD_PRIORITY",
        "subscription_interval": "MONTH YEAR",
        "subscription_status": "ACTIVE PAST_DUE CANCELED EXPIRED",
        "task_status": "PENDING RUNNING SUCCEEDED FAILED CANCELED",
        "template_type": "DEMO PRODUCTION_WEB",
        "website_classification": "EXCELLENT GOOD AVERAGE WEAK VERY_WEAK NO_WEBSITE",
        "website_status": "NO_WEBSITE DISCOVERED SCRAPED ANALYZED CRAWL_FAILED",
        "website_version_status": "DRAFT QA DEPLOYED ROLLED_BACK",
    }.items()
}

# Columns besides the rule's own (see ``table``), as name:type, ! not null, =default.
_COLUMNS: dict[str, str] = {
    "audit_logs": "actor_type:audit_actor_type! actor_id:uuid action:text! entity_type:text! entity_id:uuid! before:json after:json source:text metadata:json created",
    "businesses": "business_name:text! industry:text! address:text city:text state:text zip:text phone:text email:text website_url:text source:text! source_url:text"
    " rating:numeric(2,1) review_count:int business_description:text services:json service_area:json hours:json business_status:business_operational_status=UNKNOWN"
    " decision_maker_name:text decision_maker_role:text contactability_score:int provenance:json lifecycle_state:lead_lifecycle_state!=DISCOVERED created updated",
    "contacts": "business_id:uuid! name:text! role:text email:text phone:text source:text verified_at:time contactability_score:int status:contact_status!=ACTIVE created updated",
    "conversation_messages": "conversation_id:uuid! direction:message_direction! classification:reply_classification classification_confidence:numeric(4,3) body:text!"
    " received_at:time sent_at:time created",
    "conversations": "business_id:uuid! contact_id:uuid status:conversation_status!=OPEN last_message_at:time created updated",
    "customer_onboarding": "customer_id:uuid! status:onboarding_status!=PENDING requested_fields:json collected_fields:json onboarding_form_url:text completed_at:time created updated",
    "customers": "business_id:uuid email:text! name:text! status:customer_status!=ACTIVE billing_email:text created updated",
    "demos": "business_id:uuid template_id:uuid status:demo_status!=GENERATING demo_url:text design_config:json content_payload:json version:int=1 qa_results:json created updated",
    "domains": "customer_id:uuid name:text! status:domain_status!=AVAILABLE registrar_ref:text dns_verified_at:time created updated",
    "exceptions": "entity_type:text! entity_id:uuid priority:exception_priority! category:text! status:exception_status!=OPEN message:text! details:json"
    " first_seen_at:time!=now last_seen_at:time!=now resolved_at:time created updated",
    "followups": "outreach_message_id:uuid! sequence_step:int scheduled_at:time sent_at:time status:followup_status!=PENDING created updated",
    "lead_scores": "business_id:uuid! website_quality_score:int business_opportunity_score:int market_fit_score:numeric(5,2) lead_priority_score:numeric(5,2)"
    " classification:lead_classification formula_fields:json scoring_version:uuid created",
    "lead_state_history": "business_id:uuid! from_state:lead_lifecycle_state to_state:lead_lifecycle_state! note:text created",
    "metrics": "metric_date:date! metric_name:text! value:numeric(14,2)! dimension:json!={} dimension_key:text created",
    "outreach_campaigns": "name:text! status:campaign_status!=DRAFT audience_query:json email_template_id:uuid daily_limit:int start_date:date created updated",
    "outreach_messages": "business_id:uuid! campaign_id:uuid contact_id:uuid status:message_status!=PENDING subject:text body:text sent_at:time message_id_external:text"
    " opened_at:time clicked_at:time created updated",
    "payments": "customer_id:uuid! subscription_id:uuid status:payment_status!=PENDING amount_cents:int! currency:text!=usd external_ref:text paid_at:time created updated",
    "production_websites": "customer_id:uuid! status:production_website_status!=ONBOARDING_COMPLETE domain_id:uuid version:int=1 url:text created updated",
    "sales_opportunities": "business_id:uuid! customer_id:uuid status:opportunity_status!=OPEN source_lead_id:uuid demo_url:text value_estimate_cents:int won_at:time lost_at:time created updated",
    "scoring_versions": "score_type:scoring_type! version:int! weights:json! description:text is_active:bool!=false created",
    "subscriptions": "customer_id:uuid! plan:text! status:subscription_status!=ACTIVE amount_cents:int! currency:text!=usd interval:subscription_interval!=MONTH"
    " current_period_start:time current_period_end:time canceled_at:time created updated",
    "system_settings": "key:text! value:json! type:text! description:text is_feature_flag:bool!=false updated",
    "tasks": "entity_type:text! entity_id:uuid! type:text! status:task_status!=PENDING attempts:int!=0 payload:json result:json scheduled_at:time started_at:time finished_at:time created updated",
    "templates": "type:template_type! name:text! template_schema:json is_active:bool!=true version:int!=1 created updated",
    "website_analyses": "website_id:uuid! website_quality_score:int classification:website_classification! category_scores:json test_results:json evidence:json"
    " critical_failures:json analysis_version:uuid analyzed_at:time created",
    "website_versions": "production_website_id:uuid! version_number:int! status:website_version_status!=DRAFT change_notes:text created",
    "websites": "business_id:uuid url:text! status:website_status!=DISCOVERED http_status:int domain:text discovered_at:time created updated",
}

# Child.column parent action; every parent column is ``id``.
_FOREIGN_KEYS = """
contacts.business_id businesses cascade
conversation_messages.conversation_id conversations cascade
conversations.business_id businesses cascade
conversations.contact_id contacts cascade
customer_onboarding.customer_id customers cascade
customers.business_id businesses set_null
demos.business_id businesses set_null
demos.template_id templates set_null
domains.customer_id customers set_null
followups.outreach_message_id outreach_messages cascade
lead_scores.business_id businesses cascade
lead_scores.scoring_version scoring_versions restrict
lead_state_history.business_id businesses cascade
outreach_campaigns.email_template_id templates set_null
outreach_messages.business_id businesses cascade
outreach_messages.campaign_id outreach_campaigns set_null
outreach_messages.contact_id contacts cascade
payments.customer_id customers cascade
payments.subscription_id subscriptions set_null
production_websites.customer_id customers cascade
production_websites.domain_id domains set_null
sales_opportunities.business_id businesses cascade
sales_opportunities.customer_id customers set_null
sales_opportunities.source_lead_id businesses set_null
subscriptions.customer_id customers cascade
website_analyses.website_id websites cascade
website_analyses.analysis_version scoring_versions restrict
website_versions.production_website_id production_websites cascade
websites.business_id businesses set_null
"""

# Unique constraints as name: table columns; nulls are distinct.
_UNIQUES = """
u_customer_onboarding_customer_id: customer_onboarding customer_id
u_customers_business_id: customers business_id
u_domains_name: domains name
u_metrics_date_name_dim: metrics metric_date metric_name dimension_key
u_payments_external_ref: payments external_ref
u_scoring_versions_type_version: scoring_versions score_type version
u_templates_type_name_version: templates type name version
u_website_versions_site_number: website_versions production_website_id version_number
u_websites_url: websites url
"""

# Checks as name: table predicate; a null result passes.
_CHECKS = """
chk_businesses_contactability: businesses contactability_score BETWEEN 0 AND 100
chk_businesses_rating: businesses rating BETWEEN 0 AND 5
chk_contacts_contactability: contacts contactability_score BETWEEN 0 AND 100
chk_conversation_messages_conf: conversation_messages classification_confidence BETWEEN 0 AND 1
chk_lead_scores_bos: lead_scores business_opportunity_score BETWEEN 0 AND 100
chk_lead_scores_market_fit: lead_scores market_fit_score BETWEEN 0 AND 100
chk_lead_scores_priority: lead_scores lead_priority_score BETWEEN 0 AND 100
chk_lead_scores_wsq: lead_scores website_quality_score BETWEEN 0 AND 100
chk_outreach_campaigns_daily_limit: outreach_campaigns daily_limit > 0
chk_payments_amount: payments amount_cents > 0
chk_subscriptions_amount: subscriptions amount_cents > 0
chk_system_settings_type: system_settings type IN ('string', 'number', 'boolean', 'json', 'array')
chk_website_analyses_score: website_analyses website_quality_score BETWEEN 0 AND 100
"""

# Indexes as name: table columns.
_INDEXES = """
idx_audit_logs_entity: audit_logs entity_type entity_id
idx_audit_logs_created_at: audit_logs created_at
idx_businesses_lifecycle_state: businesses lifecycle_state
idx_businesses_state_city: businesses state city
idx_businesses_city_state_zip: businesses city state zip
idx_businesses_source: businesses source
idx_businesses_industry: businesses industry
idx_businesses_zip: businesses zip
idx_contacts_business_id: contacts business_id
idx_contacts_email: contacts email
idx_contacts_status: contacts status
idx_conversation_messages_conversation_id: conversation_messages conversation_id
idx_conversations_business_id: conversations business_id
idx_conversations_status: conversations status
idx_customer_onboarding_status: customer_onboarding status
idx_demos_business_id: demos business_id
idx_demos_status: demos status
idx_demos_template_id: demos template_id
idx_domains_customer_id: domains customer_id
idx_domains_status: domains status
idx_exceptions_status_priority: exceptions status priority
idx_exceptions_entity: exceptions entity_type entity_id
idx_exceptions_first_seen_at: exceptions first_seen_at
idx_followups_outreach_message_id: followups outreach_message_id
idx_followups_status_scheduled_at: followups status scheduled_at
idx_lead_scores_business_id: lead_scores business_id
idx_lead_scores_created_at: lead_scores created_at
idx_lead_scores_classification: lead_scores classification
idx_lead_scores_priority: lead_scores lead_priority_score
idx_lead_state_history_business_id: lead_state_history business_id
idx_lead_state_history_business_created: lead_state_history business_id created_at
idx_outreach_campaigns_status: outreach_campaigns status
idx_outreach_messages_business_id: outreach_messages business_id
idx_outreach_messages_campaign_id: outreach_messages campaign_id
idx_outreach_messages_status: outreach_messages status
idx_outreach_messages_contact_id: outreach_messages contact_id
idx_payments_customer_id: payments customer_id
idx_payments_status: payments status
idx_production_websites_customer_id: production_websites customer_id
idx_sales_opportunities_status: sales_opportunities status
idx_sales_opportunities_business_id: sales_opportunities business_id
idx_sales_opportunities_customer_id: sales_opportunities customer_id
idx_scoring_versions_active: scoring_versions score_type is_active
idx_subscriptions_customer_id: subscriptions customer_id
idx_subscriptions_status: subscriptions status
idx_tasks_status_scheduled_at: tasks status scheduled_at
idx_tasks_entity: tasks entity_type entity_id
idx_tasks_type: tasks type
idx_website_analyses_website_id: website_analyses website_id
idx_website_analyses_analyzed_at: website_analyses analyzed_at
idx_website_versions_production_website_id: website_versions production_website_id
idx_websites_business_id: websites business_id
idx_websites_status: websites status
"""

_TYPES: dict[str, DataType] = {
    "uuid": StringType(), "text": StringType(), "time": TimestampType(), "json": VariantType(), "int": IntegerType(), "bool": BooleanType(), "date": DateType(),
}


@dataclass(frozen=True)
class Column:
    """``kind``: uuid, text, time, json, int, bool, date, numeric(p,s) or an enum's name."""

    name: str
    kind: str
    required: bool = False
    default: str | None = None

    @property
    def enum(self) -> tuple[str, ...] | None:
        return ENUMS.get(self.kind)

    @property
    def type(self) -> DataType:
        if self.kind.startswith("numeric"):
            return DecimalType(*map(int, self.kind[8:-1].split(",")))
        return StringType() if self.enum else _TYPES[self.kind]


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    action: str

    @property
    def name(self) -> str:
        return f"{self.child}_{self.column}_{self.parent}_id_fk"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: str
    uniques: dict[str, tuple[str, ...]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        """Nullable as declared; the enum of a column is in its field's metadata."""
        return StructType([StructField(c.name, c.type, not c.required, {"enum": c.kind} if c.enum else {}) for c in self.columns])

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


def _lines(text: str) -> list[tuple[str, str]]:
    return [(a, b.strip()) for a, _, b in (line.partition(":") for line in text.strip().splitlines())]


def _column(spec: str) -> Column:
    name, _, rest = spec.partition(":")
    kind, _, default = rest.partition("=")
    return Column(name, kind.rstrip("!"), kind.endswith("!"), default or None)


@cache
def foreign_keys() -> tuple[ForeignKey, ...]:
    rows = (line.split() for line in _FOREIGN_KEYS.strip().splitlines())
    return tuple(ForeignKey(*child.split("."), parent, action) for child, parent, action in rows)


@cache
def tables() -> dict[str, Table]:
    """All tables.  By rule each has a random ``id`` as its key unless a first column ``key`` is it, and the time columns it names."""
    out = {}
    for name, spec in _COLUMNS.items():
        columns = []
        for word in spec.split():
            columns.append(Column(f"{word}_at", "time", True, "now") if word in ("created", "updated") else _column(word))
        key = "key" if columns[0].name == "key" else "id"
        if key == "id":
            columns.insert(0, Column("id", "uuid", True, "random"))
        uniques = {n: tuple(r.split()[1:]) for n, r in _lines(_UNIQUES) if r.split()[0] == name}
        checks = {n: r.split(" ", 1)[1] for n, r in _lines(_CHECKS) if r.split()[0] == name}
        indexes = {n: tuple(r.split()[1:]) for n, r in _lines(_INDEXES) if r.split()[0] == name}
        out[name] = Table(name, tuple(columns), key, uniques, checks, indexes)
    return out


def load_order() -> list[list[str]]:
    """Tables by level: those of a level refer to lower levels only."""
    left, done, levels = set(tables()), set(), []
    while left:
        level = sorted(t for t in left if all(fk.parent in done for fk in foreign_keys() if fk.child == t))
        levels.append(level)
        done |= set(level)
        left -= set(level)
    return levels
