"""Deciding what a question is about: intent, time range, and the tables it needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of off-topic questions and of intents.
OFF_TOPIC = (
    r"(?i)\b(stock|crypto|bitcoin|forex|weather|recipe|cook|sport|footbal|basket|footbal|nfl|nba|politic|election|celebrity|movie|music|travel|hotel|flight|restaurant|shopping|fashion|game|gaming)\b",
    r"(?i)\b(how to|tell me a joke|write a poem|translate|what is the capital|who is|history of|meaning of)\b",
)
FETCH = r"(?i)(show me|give me|get me|fetch|query|how many|count|list|find|what are|select|which patients|top \d|breakdown|compare|average|total|sum of)"
NOT_FETCH = r"(?i)(chart|graph|plot|visuali|pie|bar|line)"
CHART = r"(?i)(chart|graph|plot|visuali|pie|bar|line|donut|scatter|viz|show me)"

# Phrases and the predicates they stand for, in the order they are tried.
TIME_RANGES = {
    "today": "DATE(AcceptanceDate) = CURRENT_DATE",
    "this week": "AcceptanceDate >= DATE_TRUNC('week', CURRENT_DATE)",
    "this month": "AcceptanceDate >= DATE_TRUNC('month', CURRENT_DATE)",
    "last 30 days": "AcceptanceDate >= NOW() - INTERVAL '30 days'",
    "last 90 days": "AcceptanceDate >= NOW() - INTERVAL '90 days'",
    "last year": "AcceptanceDate >= NOW() - INTERVAL '1 year'",
    "ytd": "AcceptanceDate >= DATE_TRUNC('year', CURRENT_DATE)",
}

# Logical tables with their keywords, in declared order.
KEYWORDS = [
    ("Acceptances", ["patient", "admission", "accept", "discharge", "stay", "length", "status", "diagnosis", "admit"]),
    ("Units", ["unit", "icu", "ward", "bed", "capacity", "department"]),
    ("Departments", ["department", "dept", "division", "section"]),
    ("Hospitals", ["hospital", "facility", "clinic", "center", "site"]),
    ("Patients", ["patient", "age", "gender", "blood", "demographic", "nationality"]),
    ("Doctors", ["doctor", "physician", "specialist", "staff", "provider"]),
    ("VitalSigns", ["vital", "heart", "blood pressure", "temperature", "oxygen", "saturation", "bp", "hr"]),
    ("Diagnoses", ["diagnosis", "diagnos", "icd", "code", "condition", "disease"]),
    ("CriticalPatients", ["critical", "apache", "gcs", "icu", "ventilator", "eclinics", "intensive"]),
    ("DrugAlerts", ["drug", "alert", "medication", "pump", "infusion", "severity"]),
    ("ClinicalNotes", ["note", "clinical note", "summary", "doctor note", "observation"]),
]
PRIMARY = "Acceptances"


def intent(text: Column, has_results: Column) -> Column:
    """off_topic, sql, chart (only over results) or chat, in that order."""
    off = text.rlike(OFF_TOPIC[0]) | text.rlike(OFF_TOPIC[1])
    return F.when(off, "off_topic").when(text.rlike(FETCH) & ~text.rlike(NOT_FETCH), "sql").when(text.rlike(CHART) & has_results, "chart").otherwise("chat")


def time_range(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(phrase)), sql) for phrase, sql in TIME_RANGES.items()])


# What each role may do.
ROLES = {
    "admin": ("query:run", "query:export", "narrative:generate", "dashboard:write", "dashboard:read", "chart:write", "alert:write", "report:write", "audit:read", "admin:manage"),
    "analyst": ("query:run", "query:export", "narrative:generate", "dashboard:write", "dashboard:read", "chart:write", "alert:write", "report:write"),
    "clinician": ("query:run", "narrative:generate", "dashboard:read"),
}


def permitted(role: Column, permission: Column) -> Column:
    table = F.create_map(*[x for r, ps in ROLES.items() for x in (F.lit(r), F.array(*map(F.lit, ps)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, role), permission), F.lit(False))


def in_catalog(catalog: Column, wanted: Column) -> Column:
    """Whether a table of that catalog is offered: it has none, is asked for, or both catalogs are."""
    return F.coalesce((wanted == "both") | catalog.isNull() | (catalog == wanted), F.lit(False))


def catalog_choice(telehealth: Column, eclinics: Column) -> Column:
    """The catalog with the higher score; ties go to eclinics."""
    return F.when(telehealth > eclinics, "telehealth").otherwise("eclinics")
