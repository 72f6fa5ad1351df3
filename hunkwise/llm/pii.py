"""Personal data by weak supervision, native.

Patterns give candidate spans. Five labelers vote on each (for, against, silent): the strict
rule of its kind, its form, a gazetteer, the words before it, and its edges. How often each
combination of votes occurs is counted in the cluster; there are at most 3^5 for each kind,
whatever the input, and only these counts reach the driver. On them, expectation-maximisation
estimates how reliable each labeler is, and the posteriors train a logistic span
classifier, which is applied as a column expression.

Spans of the base rules always stay. The classifier adds others that do not overlap them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkwise.llm.common import same, written

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]

# The base patterns, written so that no text makes them slow: possessive, and begun only
# where a run of their characters begins. They find what the plain forms find, chains of
# fewer than 12 digits aside, which no rule accepts.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider candidates.
SPELLED_EMAIL = (
    rf"(?<!{LOCAL}){LOCAL}++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"
)
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"

RULES: list[tuple[str, str, str]] = [  # kind, pattern, what a text must hold
    ("email", EMAIL, "@"),
    ("ip", IP, "[0-9]"),
    ("card", CARD, "[0-9]"),
    ("phone", PHONE, "[0-9]"),
    ("email", SPELLED_EMAIL, "[(\\[]at[)\\]]"),
    ("phone", LOCAL_PHONE, "[0-9]"),
    ("secret", SECRET, "[0-9]"),
]
BASE_RULES = 4
BEFORE = 24

TOP_LEVEL = "com org net edu gov io co uk de fr es it eu us info biz ch nl at be".split()
SECRET_PREFIXES = "sk- ghp_ gho_ AKIA xox glpat- eyJ AIza".split()
HINTS = {
    "email": "mail contact write reply",
    "ip": "ip host server address client",
    "card": "card visa master credit debit payment",
    "phone": "phone call tel mobile fax whatsapp",
    "secret": "token key secret password passwd credential bearer",
}
AGAINST = "version isbn order invoice page figure section commit sha checksum hash"
LABELERS = ["strict", "form", "gazetteer", "context", "edges"]


@dataclass(frozen=True)
class Learning:
    """``accept``: the probability from which a candidate is a span."""

    rounds: int = 30
    steps: int = 150
    rate: float = 0.5
    accept: float = 0.6


def _found(text: Column, rule: int) -> Column:
    """Matches of a rule in order: (rule, gap, before, body, after), gap being what stands since the last."""
    _, pattern, need = RULES[rule]
    pieces, bodies = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(pieces, bodies, lambda p, b: F.struct(p.alias("p"), b.alias("b")))
    three = F.zip_with(pairs, F.slice(pieces, F.lit(2), F.size(pieces)), lambda x, n: F.struct(x.alias("x"), n.alias("n")))
    rows = F.transform(
        F.filter(three, lambda z: z["x"]["b"].isNotNull()),
        lambda z: F.struct(
            F.lit(rule).alias("rule"),
            F.length(z["x"]["p"]).cast("long").alias("gap"),
            F.lower(F.right(z["x"]["p"], F.lit(BEFORE))).alias("before"),
            z["x"]["b"].alias("body"),
            F.left(z["n"], F.lit(1)).alias("after"),
        ),
    )
    none = F.array().cast("array<struct<rule:int,gap:bigint,before:string,body:string,after:string>>")
    holds = text.contains(need) if need == "@" else text.rlike(need)
    return F.when(holds, rows).otherwise(none)


def _digits() -> Column:
    return F.regexp_replace("body", "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Digits from the right, every second doubled; the sum of all figures is a multiple of ten."""
    figures = F.reverse(F.split(digits, ""))
    doubled = F.transform(
        F.filter(figures, lambda x: x != ""),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def strict_rule() -> Column:
    """Whether a match passes the base rule of its kind; null for candidates that have none."""
    n = F.length(_digits())
    # A part is at most 255: leading zeros aside, three digits at most.
    parts = F.transform(F.split("body", r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    low = F.forall(parts, lambda x: F.when(F.length(x) > 3, F.lit(False)).otherwise(x.cast("int") <= 255))
    return (
        F.when(F.col("rule") == 0, F.lit(True))
        .when(F.col("rule") == 1, low)
        .when((F.col("rule") == 2) & (n > 19), F.lit(False))
        .when(F.col("rule") == 2, luhn(_digits()))
        .when(F.col("rule") == 3, n.between(9, 15))
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _words(words: str) -> str:
    return "(" + "|".join(words.split()) + ")"


def with_votes(spans: DataFrame) -> DataFrame:
    """Add the five votes; a labeler that says nothing of a kind is silent."""
    kind, body, n = F.col("kind"), F.col("body"), F.length(_digits())
    strict = F.coalesce(F.when(F.col("base"), 1).when(F.col("rule") < BASE_RULES, -1), F.lit(0))
    letters = F.length(F.regexp_replace(body, "[^A-Za-z]", ""))
    form = (
        F.when(kind == "email", _vote(F.length(body).between(6, 80), F.length(body) > 120))
        .when(kind == "ip", _vote(F.length(body).between(7, 15), F.length(body) > 15))
        .when(kind == "card", _vote((n == 16) | (n == 15), n > 19))
        .when(kind == "phone", _vote(n.between(10, 13), (n < 7) | (n > 15)))
        .otherwise(_vote((n >= 4) & (letters >= 4), n < 2))
    )
    tail = F.lower(F.regexp_extract(body, r"([A-Za-z0-9-]+)$", 1))
    prefix = "^(?:" + "|".join(SECRET_PREFIXES) + ")"
    gazetteer = (
        F.when(kind == "email", _vote(tail.isin(TOP_LEVEL), tail.rlike("[0-9]")))
        .when(kind == "ip", _vote(~body.rlike(r"^(?:0|127|255)\."), body.rlike(r"^(?:0|255)\.")))
        .when(kind == "card", _vote(_digits().rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), _digits().rlike("^0{4}")))
        .when(kind == "phone", _vote(body.rlike(r"^(?:\+[1-9]|\()"), body.rlike(r"^\+0")))
        .otherwise(_vote(body.rlike(prefix) | body.rlike("^[0-9a-f]{32,64}$"), F.lit(False)))
    )
    hint = F.lit(False)
    for k, words in HINTS.items():
        hint = hint | ((kind == k) & F.col("before").rlike(_words(words)))
    context = _vote(hint, F.col("before").rlike(_words(AGAINST)))
    touching = F.col("before").rlike("[a-z0-9]$") | F.col("after").rlike("[A-Za-z0-9]")
    return spans.withColumns(
        {"strict": strict, "form": form, "gazetteer": gazetteer, "context": context, "edges": F.when(touching, -1).otherwise(1)}
    )


def find_candidates(docs: DataFrame, text: str) -> DataFrame:
    """(row, rule, kind, start, end, body, before, after, base) of ``docs`` (row, hits). Offsets are code points."""
    hits = docs.select("row", F.posexplode("hits").alias("pos", "hit")).select("row", "pos", "hit.*")
    past = Window.partitionBy("row", "rule").orderBy("pos")
    ends = F.sum(F.col("gap") + F.length("body")).over(past)
    kinds = F.array(*[F.lit(k) for k, _, _ in RULES])
    return hits.select(
        "row",
        "rule",
        F.get(kinds, F.col("rule")).alias("kind"),
        (ends - F.length("body")).alias("start"),
        ends.alias("end"),
        "body",
        "before",
        "after",
        F.coalesce(strict_rule(), F.lit(False)).alias("base"),
    )


def estimate(counts: list[tuple[str, tuple[int, ...], int]], learning: Learning = Learning()) -> list[float]:
    """Posterior of every (kind, votes, count), by expectation-maximisation.

    Labelers are independent given the truth, and each has one reliability for all
    kinds: the chance of each vote on a true and on a false candidate. It begins with the
    mean vote; every count is smoothed.
    """
    post = [min(0.95, max(0.05, 0.5 + 0.45 * sum(v) / len(v))) for _, v, _ in counts]
    for _ in range(learning.rounds):
        prior: dict[str, list[float]] = {}
        votes = [[{-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}] for _ in LABELERS]
        # The smoothing expects labelers to be right rather than wrong.
        for pair in votes:
            pair[1][1] += 2.0
            pair[0][-1] += 2.0
        for (kind, v, n), p in zip(counts, post, strict=True):
            both = prior.setdefault(kind, [1.0, 1.0])
            both[0] += n * (1 - p)
            both[1] += n * p
            for j, x in enumerate(v):
                votes[j][0][x] += n * (1 - p)
                votes[j][1][x] += n * p
        sums = [[sum(side.values()) for side in pair] for pair in votes]
        for i, (kind, v, _) in enumerate(counts):
            odds = math.log(prior[kind][1] / prior[kind][0])
            for j, x in enumerate(v):
                odds += math.log(votes[j][1][x] / sums[j][1]) - math.log(votes[j][0][x] / sums[j][0])
            post[i] = 1 / (1 + math.exp(-min(30.0, max(-30.0, odds))))
    return post


def _features(kind: str, votes: tuple[int, ...]) -> list[int]:
    """Places of the features that are on: the kind, and each vote that is not silent."""
    return [KINDS.index(kind)] + [len(KINDS) + 2 * j + (x > 0) for j, x in enumerate(votes) if x]


def train(counts: list[tuple[str, tuple[int, ...], int]], learning: Learning = Learning()) -> list[float]:
    """Weights of a logistic classifier of the posteriors; a combination weighs as often as it occurs."""
    weights = [0.0] * (len(KINDS) + 2 * len(LABELERS))
    total = sum(n for _, _, n in counts)
    soft = estimate(counts, learning) if counts else []
    for _ in range(learning.steps if total else 0):
        slope = [0.001 * w for w in weights]
        for (kind, v, n), y in zip(counts, soft, strict=True):
            on = _features(kind, v)
            z = sum(weights[i] for i in on)
            d = (1 / (1 + math.exp(-min(30.0, max(-30.0, z)))) - y) * n / total
            for i in on:
                slope[i] += d
        weights = [w - 4 * learning.rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def probability(weights: list[float]) -> Column:
    z = F.lit(0.0)
    for i, k in enumerate(KINDS):
        z = z + F.when(F.col("kind") == k, weights[i]).otherwise(0.0)
    for j, name in enumerate(LABELERS):
        no, yes = weights[len(KINDS) + 2 * j : len(KINDS) + 2 * j + 2]
        z = z + F.when(F.col(name) > 0, yes).when(F.col(name) < 0, no).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find_personal_data(docs: DataFrame, learning: Learning = Learning(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (start, place, kind, end, base, probability).

    ``place`` is the number of the kind; spans are ordered by start, then place. Null and
    empty texts have none. Rows that repeat have the same spans; a null id is kept. Spans
    of different kinds may overlap, except that the classifier adds none that overlaps
    a base span. An empty table gives no rows; other columns are not looked at.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.flatten(F.array(*[_found(F.col("body"), r) for r in range(len(RULES))])).alias("hits"),
    )
    rows = written(rows, "pii-hits")
    candidates = written(with_votes(find_candidates(rows, text)), "pii-candidates")
    seen = candidates.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()  # 3^5 of a kind at most
    counts = sorted((r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in seen)
    scored = candidates.withColumn("probability", probability(train(counts, learning)))
    # Overlap with a base span: one that began before and goes on, or begins inside.
    along = Window.partitionBy("row").orderBy("start", "end", "rule")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(along.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    places = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = (
        scored.withColumn("free", free)
        .filter(F.col("base") | (F.col("free") & (F.col("probability") >= learning.accept)))
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_set(F.struct("start", places.alias("place"), "kind", "end", "base", "probability"))
            ).alias("spans")
        )
    )
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint,base:boolean,probability:double>>")
    return (
        rows.alias("r")
        .join(spans.alias("s"), same((F.col("r.row"), F.col("s.row"))), "left")
        .select("r.doc_id", F.coalesce("s.spans", none).alias("spans"))
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span as its kind in brackets; what overlaps the span before it is part of that."""
    first = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(
            F.concat(
                a["text"],
                F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                F.concat(F.lit("["), s["kind"], F.lit("]")),
            ).alias("text"),
            s["end"].alias("at"),
        ),
    ).otherwise(a)
    done = F.aggregate(spans, first, step)
    return F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
