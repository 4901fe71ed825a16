"""Domains of texts, with our own words on what a rewrite must keep in each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the domains. Beside each: what it covers; what must survive (the privacy
#: text is the same unless a third entry is given).
DOMAINS: dict[str, tuple[str, ...]] = {
    "BIOGRAPHY_PROFILE": ("lives and careers", "roles, training and turning points, without exact places and dates"),
    "INSURANCE": ("policies and claims", "cover, claim, decision and its reason, without policy or claim numbers"),
    "GOVERNMENT_PUBLIC_RECORDS": ("records of public bodies", "act, body, status and legal ground"),
    "NEWS_PUBLIC_AFFAIRS": ("reports of events", "what happened, in what order, and why it matters"),
    "MARKETING_COMMERCIAL": ("offers and campaigns", "product, audience and claim made"),
    "TECHNICAL_SOFTWARE_ENGINEERING": ("code, systems and incidents", "design, cause and remedy, without hosts and keys", "credentials, hosts and user names identify"),
    "RESEARCH_SCIENTIFIC": ("studies and findings", "question, method, finding and its limits"),
    "SECURITY_INFOSEC": ("attacks and defences", "weakness, path, effect and response", "addresses, keys and accounts identify"),
    "FINANCIAL": ("accounts and payments", "product, amounts as ranges, decision", "account numbers and exact amounts identify"),
    "ECONOMIC_ANALYSIS": ("markets and forecasts", "measure, trend, cause and forecast"),
    "POLICY_REGULATORY": ("rules and proposals", "rule, those concerned, effect and date as a period"),
    "LEGAL": ("cases, contracts and rulings", "parties by role, claim, ground and outcome", "docket numbers, dates and courts together identify"),
    "HR_EMPLOYMENT": ("hiring, pay and conduct", "role, event, assessment and outcome"),
    "BUSINESS_OPERATIONS": ("plans and processes", "aim, step, duty and result"),
    "MEDICAL_CLINICAL": ("care of patients", "complaint, finding, treatment and course", "rare conditions with dates and places identify"),
    "EDUCATION": ("teaching and learning", "level, subject, progress and result"),
    "CREATIVE_FICTION": ("stories and verse", "plot, figures, mood and voice"),
    "ENTERTAINMENT_MEDIA": ("shows, games and their makers", "work, genre and reception"),
    "SOCIAL_COMMENTARY": ("opinions on society", "position, grounds and tone"),
    "META_TEXT": ("texts about texts", "what is said of the other text"),
    "OTHER": ("anything else", "what is said, by whom and to what end"),
}


def _lookup(domain: Column, at: int) -> Column:
    texts = {k: v[at] if at < len(v) else v[1] for k, v in DOMAINS.items()}
    known = F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.upper(domain)), F.lit(texts["OTHER"]))


def quality_guidance(domain: Column) -> Column:
    return _lookup(domain, 1)


def privacy_guidance(domain: Column) -> Column:
    return _lookup(domain, 2)


def listing() -> str:
    """A line for each domain, for the prompt that asks for one."""
    return "\n".join(f"- {k}: {v[0]}" for k, v in DOMAINS.items())
