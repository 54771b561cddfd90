"""Ordered keyword families: derive a family from a title, label a title for a category."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from matchloom.functions.keys import category_key
from matchloom.functions.text import normalize_text

Taxonomy = Mapping[str, Sequence[str]]

OTHER = "OTHER"

# The default families with their title keywords. Declaration order decides which
# family wins when a title holds keywords of several.
FAMILIES: dict[str, tuple[str, ...]] = {
    "ACCOUNTANT": ("accountant", "accounting", "auditor", "bookkeeper", "tax accountant", "financial accountant"),
    "ADVOCATE": ("advocate", "attorney", "lawyer", "legal counsel", "paralegal", "legal advisor"),
    "AGRICULTURE": ("agriculture", "agronomist", "farm", "farmer", "horticulture", "crop", "livestock"),
    "APPAREL": ("apparel", "fashion", "garment", "textile", "merchandiser", "clothing", "retail buyer"),
    "ARTS": ("artist", "arts", "creative", "illustrator", "art director", "museum", "gallery"),
    "AUTOMOBILE": ("automotive", "automobile", "mechanic", "car technician", "service advisor", "auto technician"),
    "AVIATION": ("aviation", "pilot", "flight attendant", "airline", "aerospace", "aircraft", "aircrew"),
    "BANKING": ("banking", "banker", "bank manager", "loan officer", "credit analyst", "branch manager"),
    "BPO": ("bpo", "call center", "customer support", "customer service", "contact center", "telecaller"),
    "BUSINESS-DEVELOPMENT": (
        "business development", "partnership", "account executive", "sales development", "bdm", "alliances",
    ),
    "CHEF": ("chef", "cook", "culinary", "pastry chef", "commis", "kitchen manager"),
    "CONSTRUCTION": (
        "construction", "site engineer", "civil engineer", "project manager", "quantity surveyor", "foreman",
    ),
    "CONSULTANT": ("consultant", "advisor", "adviser", "strategy", "management consultant", "business consultant"),
    "DESIGNER": ("designer", "graphic designer", "ui designer", "ux designer", "product designer", "visual designer"),
    "DIGITAL-MEDIA": (
        "digital media", "content creator", "social media", "video editor", "digital marketing", "media planner",
    ),
    "ENGINEERING": (
        "engineer", "engineering", "mechanical engineer", "electrical engineer", "process engineer", "project engineer",
    ),
    "FINANCE": ("finance", "financial analyst", "fp&a", "controller", "investment analyst", "treasury", "risk analyst"),
    "FITNESS": ("fitness", "trainer", "personal trainer", "coach", "gym instructor", "wellness"),
    "HEALTHCARE": ("healthcare", "nurse", "doctor", "medical", "pharmacist", "therapist", "clinical"),
    "HR": ("hr", "human resources", "recruiter", "talent acquisition", "people operations", "hr manager"),
    "INFORMATION-TECHNOLOGY": (
        "information technology", "software engineer", "software developer", "developer", "programmer",
        "systems administrator", "system administrator", "devops", "data engineer", "data analyst",
        "solutions architect", "technical support", "it support",
    ),
    "PUBLIC-RELATIONS": (
        "public relations", "pr manager", "communications", "media relations", "brand communications",
    ),
    "SALES": ("sales", "sales manager", "sales associate", "account manager", "sales executive", "inside sales"),
    "TEACHER": ("teacher", "educator", "instructor", "lecturer", "tutor", "faculty", "trainer"),
}


def plain(text: str) -> str:
    """Driver-side twin of ``normalize_text`` for keywords, which are parameters and not data."""
    return re.sub("[^0-9A-Za-z]+", " ", unicodedata.normalize("NFKC", text)).strip().lower()


def keyword_pattern(keywords: Sequence[str]) -> str:
    """Pattern that finds any keyword as whole words of a normalised title."""
    return "(?:^| )(?:" + "|".join(plain(k) for k in keywords) + ")(?: |$)"


def derive_family(
    title: Column | str, taxonomy: Taxonomy = FAMILIES, default: str = OTHER, unicode: bool = True
) -> Column:
    """First family in declaration order one of whose keywords stands in the title, else ``default``."""
    title = normalize_text(title, unicode)
    matched = None
    for family, keywords in taxonomy.items():
        hit = title.rlike(keyword_pattern(keywords))
        matched = F.when(hit, family) if matched is None else matched.when(hit, family)
    return F.lit(default) if matched is None else matched.otherwise(F.lit(default))


def matched_categories(title: Column | str, taxonomy: Taxonomy = FAMILIES, unicode: bool = True) -> Column:
    """Every category whose keywords stand in the title, in declaration order."""
    title = normalize_text(title, unicode)
    return F.array_compact(
        F.array(*[F.when(title.rlike(keyword_pattern(k)), F.lit(c)) for c, k in taxonomy.items()])
    )


def label_relevance(
    category: Column | str, title: Column | str, taxonomy: Taxonomy = FAMILIES, unicode: bool = True
) -> Column:
    """1 when the title holds a keyword of the category, else 0.

    A category outside the taxonomy is its own keyword; a blank category or title gives 0.
    """
    key = category_key(category, unicode)
    title = normalize_text(title, unicode)
    own_words = F.contains(
        F.concat(F.lit(" "), title, F.lit(" ")),
        F.concat(F.lit(" "), F.lower(F.replace(key, F.lit("-"), F.lit(" "))), F.lit(" ")),
    )
    hit = F.when((key == "") | (title == ""), F.lit(False))
    for known, keywords in taxonomy.items():
        hit = hit.when(key == known, title.rlike(keyword_pattern(keywords)))
    return hit.otherwise(own_words).cast("int")
