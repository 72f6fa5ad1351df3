"""Fixed values, column orders and ranks shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed words, best first. The position is the rank; an unknown
# word ranks behind all of them.
SEVERITIES = ("critical", "high", "medium", "low")
CATEGORIES = ("bug", "security", "style", "performance")
SOURCES = ("rule", "agent", "llm")

# Limits. A client may ask for HUNK_LINE_CAP; nothing is cut by default.
HUNK_LINE_CAP = 3000
READER_LINE_LIMIT = 500
CHUNK_LINES = 50
TOP_K = 3
LINE_TOLERANCE = 3
CONFIDENCE_DEFAULT = 0.5
CONFIDENCE_THRESHOLD = 0.7
OUTPUT_BYTES = 50_000
REQUESTS_PER_WINDOW = 10
WINDOW_SECONDS = 60
COST_PER_TOKEN = (0.001, 1000)
COST_CAP = 0.05
ALARM_MIN_REVIEWS = 10
ALARM_EMPTY_RATE = 0.8
MAX_ITERATIONS = 5
TOKEN_BUDGET = 32_000

FINDING_COLUMNS = (
    "review_id",
    "file_no",
    "finding_seq",
    "file",
    "line_start",
    "line_end",
    "severity",
    "category",
    "explanation",
    "suggested_fix",
    "source",
    "confidence",
    "reasoning_trace",
)

# Layout of finding_seq, from the top: file number, family, hunk, line in hunk.
# It sorts findings of a review in the order in which they are produced.
_LINE_BITS = 20
_HUNK_BITS = 18
_FAMILY_BITS = 3
AGENT_FAMILY = 7


def finding_seq(file_no: Column, family_no: Column, hunk_no: Column, position: Column) -> Column:
    seq = file_no.cast("long")
    for bits, part in ((_FAMILY_BITS, family_no), (_HUNK_BITS, hunk_no), (_LINE_BITS, position)):
        seq = F.shiftleft(seq, bits) + part.cast("long")
    return seq


def rank_of(word: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(len(words))
    for i in reversed(range(len(words))):
        out = F.when(word == words[i], i).otherwise(out)
    return out


def severity_rank(col: str = "severity") -> Column:
    return rank_of(F.col(col), SEVERITIES)


def source_rank(col: str = "source") -> Column:
    return rank_of(F.col(col), SOURCES)


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), rank)


def columns_besides(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]
