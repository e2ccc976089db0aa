"""Fixed vocabularies and patterns."""

from __future__ import annotations

# Title words that carry no content.
TITLE_STOPWORDS = [
    "a", "an", "and", "at", "das", "de", "der", "des", "die", "el", "en", "et",
    "for", "in", "la", "le", "les", "of", "on", "the", "to", "un", "und", "une",
]

# Canonical document types that count as papers.
SUPPORTED_TYPES = [
    "article", "conference-paper", "data-paper", "forthcoming-article", "manuscript",
    "preprint", "review-article", "software-paper", "working-paper",
]

# Older spellings that count as papers.
SUPPORTED_LEGACY_TYPES = [
    "author-accepted-manuscript", "author_accepted_manuscript", "journal-article",
    "journal_article", "posted-content", "proceedings-article", "submitted-manuscript",
    "submitted_manuscript", "working_paper",
]

# Provider label -> canonical type, per provider.
TYPE_MAP = {
    "openalex": {
        "article": "article", "book": "book", "book-chapter": "book-chapter",
        "book-review": "book-review", "conference-abstract": "conference-abstract",
        "conference-paper": "conference-paper", "data-paper": "data-paper",
        "dataset": "dataset", "dissertation": "dissertation", "editorial": "editorial",
        "erratum": "erratum", "letter": "letter", "libguides": "libguides",
        "other": "other", "paratext": "paratext", "peer-review": "peer-review",
        "preprint": "preprint", "reference-entry": "reference-entry",
        "report": "working-paper", "retraction": "retraction", "review": "review-article",
        "software": "software", "software-paper": "software-paper", "standard": "standard",
        "supplementary-materials": "supplementary-materials",
    },
    "crossref": {
        "book": "book", "book-chapter": "book-chapter", "book-part": "book-chapter",
        "book-section": "book-chapter", "book-series": "book", "book-set": "book",
        "book-track": "book-chapter", "component": "other", "database": "dataset",
        "dataset": "dataset", "dissertation": "dissertation", "edited-book": "book",
        "grant": "grant", "journal": "journal-container", "journal-article": "article",
        "journal-issue": "journal-container", "journal-volume": "journal-container",
        "monograph": "book", "other": "other", "peer-review": "peer-review",
        "posted-content": "preprint", "proceedings": "proceedings-container",
        "proceedings-article": "conference-paper",
        "proceedings-series": "proceedings-container", "reference-book": "book",
        "reference-entry": "reference-entry", "report": "working-paper",
        "report-component": "other", "report-series": "report-container",
        "standard": "standard",
    },
    "feed-description": {
        "author-accepted-manuscript": "manuscript",
        "forthcoming-article": "forthcoming-article", "manuscript": "manuscript",
        "preprint": "preprint", "submitted-manuscript": "manuscript",
        "working-paper": "working-paper",
    },
    "title-label": {"book-review": "book-review"},
    "change-log": {
        "article": "article", "book": "book", "bookpart": "book-chapter",
        "bachelorthesis": "dissertation", "masterthesis": "dissertation",
        "doctoralthesis": "dissertation", "workingpaper": "working-paper",
        "preprint": "preprint",
    },
}

# Which canonical type wins when compatible labels differ.
TYPE_PREFERENCE = [
    "book-review", "book-chapter", "book", "review-article", "data-paper",
    "software-paper", "conference-paper", "forthcoming-article", "article", "preprint",
    "manuscript", "working-paper",
]

# Types a reviewer may assign after inspecting a document.
REVIEWABLE_TYPES = sorted(
    set(SUPPORTED_TYPES).union(
        TYPE_MAP["openalex"].values(),
        TYPE_MAP["crossref"].values(),
        TYPE_MAP["change-log"].values(),
    )
)

# Early-work phrases in feed descriptions, first hit wins.
TYPE_PHRASES = [
    ("author-accepted-manuscript", r"(?i)\bauthor(?:'s)? accepted manuscript\b"),
    ("working-paper", r"(?i)\bworking[ -]paper\b"),
    ("submitted-manuscript", r"(?i)\b(?:submitted|unpublished) manuscript\b"),
    ("preprint", r"(?i)\bpre[ -]?print\b"),
    ("manuscript", r"(?i)\bmanuscript\b"),
    ("forthcoming-article", r"(?i)\b(?:forthcoming|to appear)\b"),
]

# Type words that mark early work.
EARLY_WORK_MARKERS = [
    "accepted-manuscript", "forthcoming", "manuscript", "preprint", "working-paper",
    "workingpaper",
]

# Fixed value: title prefixes that announce a book review.
REVIEW_PREFIX = (
    r"(?i)^\s*[\[(]?\s*(?:"
    r"(?:book\s+)?reviews?(?:\s+essay)?(?:\s+of\b|\s*:)"
    r"|rezension(?:\s+(?:zu|von)\b|\s*:)"
    r"|compte\s+rendu(?:\s+de\b|\s*:)"
    r"|reseña(?:\s+de\b|\s*:)"
    r"|recensione(?:\s+di\b|\s*:)"
    r"|resenha(?:\s+de\b|\s*:)"
    r"|书评\s*[:：])"
)

# Events that prove publication, and sources that never do.
PUBLICATION_EVENTS = [
    "recently_published", "recently_published_online", "recently_deposited",
    "recently_assigned_to_issue",
]
OBSERVATION_SOURCES = [
    "local-system", "change-log-datestamp", "oai-datestamp", "feed-observed-at",
]

# Patterns for identifiers and hints.
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)"
DOI_SHAPE = r"^10\.[0-9]{4,9}/\S+$"
DOI_LINK = r"(?i)https?://(?:dx\.)?doi\.org/[^\s\"'<>?&]+"
YEAR_SHAPE = r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"
RECORD_PATH = r"^/rec/(?!\.{1,2}/?$)[A-Za-z0-9._~-]+/?$"
SAFE_TYPE = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
FINGERPRINT = r"^[0-9a-f]{64}$"

# How long look-ups, quarantined rows and attempts are remembered.
HIT_HOURS = 24
MISS_MINUTES = 15
TITLE_MINUTES = 60
QUARANTINE_DAYS = 365
ATTEMPT_DAYS = 31
