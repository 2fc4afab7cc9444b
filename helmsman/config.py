"""Parameters of every job, as one frozen dataclass tree.

The defaults below are FIXED VALUES: they must equal the behaviour being
reproduced (scoring constants, keyword lists, labels, prompt texts, bucket
bounds).  They are listed plainly and in their natural order.  Callers change
behaviour with ``dataclasses.replace`` rather than by editing these.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------

# Text cleaning: abbreviation -> expansion, applied in this order, whole word,
# case-insensitive.
ABBREVIATIONS: tuple[tuple[str, str], ...] = (
    ("u", "you"),
    ("ur", "your"),
    ("r", "are"),
    ("pls", "please"),
    ("thx", "thanks"),
    ("tho", "though"),
)

# PII entity names and their replacement labels (strategy "replace").
PII_LABELS: tuple[tuple[str, str], ...] = (
    ("EMAIL_ADDRESS", "[EMAIL]"),
    ("PHONE_NUMBER", "[PHONE]"),
    ("CREDIT_CARD", "[CREDIT_CARD]"),
    ("SSN", "[SSN]"),
    ("PERSON", "[NAME]"),
)
PII_DEFAULT_LABEL = "[REDACTED]"
PII_MASK_CHAR = "*"
PII_MASK_CHARS = 100

# Language detection.
SUPPORTED_LANGUAGES: tuple[str, ...] = ("en", "es", "fr")
DEFAULT_LANGUAGE = "en"
MIN_DETECT_CHARS = 10

# BM25 (Okapi) constants.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_IDF_EPSILON = 0.25

# Hybrid search.
HYBRID_ALPHA = 0.5
HYBRID_TOP_K = 5
RRF_K = 60

# Confidence scoring.
CONFIDENCE_THRESHOLD = 0.7
MIN_RETRIEVAL_SCORE = 0.3
CONFIDENCE_WEIGHTS = (0.4, 0.3, 0.3)  # top score, consistency, above-threshold share
CONSISTENCY_WINDOW = 3
LEVEL_HIGH = 0.8
LEVEL_MEDIUM = 0.5

# Sentiment.
SENTIMENT_MAX_CHARS = 512
ESCALATE_ON: tuple[str, ...] = ("negative", "urgent")
URGENT_KEYWORDS: tuple[str, ...] = (
    "urgent", "asap", "immediately", "emergency", "critical",
    "help", "stuck", "broken", "not working", "issue",
)

# Sensitive topics: (topic label, keywords).
SENSITIVE_TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("payment", ("refund", "charge", "billing", "payment", "credit card")),
    ("legal", ("lawsuit", "lawyer", "legal", "sue")),
    ("account_security", ("password", "account number", "ssn", "social security")),
)
SENSITIVE_THRESHOLD = 0.8
SENSITIVE_MATCH_NORM = 5.0

# Routing.
HANDOFF_REASONS: tuple[str, ...] = (
    "low_confidence", "sensitive_topic", "negative_sentiment", "explicit_request",
)

# Context and prompt.
CONTEXT_MAX_CHUNKS = 3
SYSTEM_PROMPT = (
    "You are a helpful customer service assistant. Use the provided context to "
    "answer customer questions accurately and professionally.\n"
    "If you don't know the answer based on the context, politely say so and offer "
    "to escalate to a human agent.\n"
    "Always be empathetic, clear, and concise.\n"
)
PROMPT_TEMPLATE = (
    "Context:\n{context}\n\nCustomer Question: {question}\n\n"
    "Please provide a helpful response based on the context above.\n"
)
SAFETY_PATTERNS: tuple[str, ...] = ("(?i)i am an ai", "(?i)as an ai language model")

# Tokenizer and embedding.
MAX_TOKENS = 512
EMBED_BATCH = 32

# Feedback.
FEEDBACK_TYPES: tuple[str, ...] = ("thumbs_up", "thumbs_down", "agent_approval", "agent_correction")
RETRAIN_THRESHOLD = 100

# Histogram bucket upper bounds.
DURATION_BUCKETS: tuple[float, ...] = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
CONFIDENCE_BUCKETS: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
STAGE_BUCKETS: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)

# Alerts.
ALERT_ERROR_RATE = 0.1
ALERT_MIN_DEFLECTION = 0.5
ALERT_P95_LATENCY_S = 5.0

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CleanParams:
    enabled: bool = True
    remove_html: bool = True
    normalize_whitespace: bool = True
    lowercase: bool = False
    abbreviations: tuple[tuple[str, str], ...] = ABBREVIATIONS


@dataclass(frozen=True)
class PiiParams:
    enabled: bool = True
    strategy: str = "replace"  # replace | mask | hash | anything else -> [REDACTED]
    entities: tuple[str, ...] = tuple(e for e, _ in PII_LABELS)
    # PERSON is recognised from a list of given names (a parameter; the default
    # list is small and English).
    person_names: tuple[str, ...] = (
        "John", "Jane", "Mary", "James", "Robert", "Michael", "David", "Sarah",
        "Maria", "Pierre", "Marie", "Juan", "Carlos", "Anna", "Peter", "Thomas",
    )
    # Further recognisers, after the built-in ones in precedence:
    # (entity name, Java regex, score, replacement label).
    recognisers: tuple[tuple[str, str, float, str], ...] = ()


@dataclass(frozen=True)
class LangParams:
    enabled: bool = True
    supported: tuple[str, ...] = SUPPORTED_LANGUAGES
    default: str = DEFAULT_LANGUAGE
    min_chars: int = MIN_DETECT_CHARS
    ngram: int = 3
    profile_max_bytes: int = 64 << 20  # a larger profile is joined by a shuffle


@dataclass(frozen=True)
class Bm25Params:
    enabled: bool = True
    k1: float = BM25_K1
    b: float = BM25_B
    epsilon: float = BM25_IDF_EPSILON
    broadcast_max_rows: int = 2_000_000  # not read any more: questions go in blocks
    # Query terms up to this many bytes go to the scoring tasks at once, as numbers.
    query_max_bytes: int = 64 << 20
    salt_buckets: int = 16  # not read any more: nothing is shuffled by term


@dataclass(frozen=True)
class VectorParams:
    # Query matrix bytes up to this bound are shipped to every KB partition;
    # beyond it queries and documents are blocked and co-grouped.
    broadcast_max_bytes: int = 256 * 1024 * 1024
    block_rows: int = 4096
    lsh_bucket_length: float = 0.5
    lsh_tables: int = 8


@dataclass(frozen=True)
class HybridParams:
    enabled: bool = True
    alpha: float = HYBRID_ALPHA
    top_k: int = HYBRID_TOP_K
    fusion: str = "rrf"  # rrf | weighted
    rrf_k: int = RRF_K


@dataclass(frozen=True)
class DecisionParams:
    threshold: float = CONFIDENCE_THRESHOLD
    min_retrieval_score: float = MIN_RETRIEVAL_SCORE
    weights: tuple[float, float, float] = CONFIDENCE_WEIGHTS
    consistency_window: int = CONSISTENCY_WINDOW
    auto_enabled: bool = True
    handoff_reasons: tuple[str, ...] = HANDOFF_REASONS
    urgent_keywords: tuple[str, ...] = URGENT_KEYWORDS
    topics: tuple[tuple[str, tuple[str, ...]], ...] = SENSITIVE_TOPICS
    sensitive_threshold: float = SENSITIVE_THRESHOLD
    escalate_on: tuple[str, ...] = ESCALATE_ON


@dataclass(frozen=True)
class Params:
    clean: CleanParams = field(default_factory=CleanParams)
    pii: PiiParams = field(default_factory=PiiParams)
    lang: LangParams = field(default_factory=LangParams)
    bm25: Bm25Params = field(default_factory=Bm25Params)
    vectors: VectorParams = field(default_factory=VectorParams)
    hybrid: HybridParams = field(default_factory=HybridParams)
    decision: DecisionParams = field(default_factory=DecisionParams)


DEFAULT = Params()
