"""The named queries as plain SQL, written apart from the Spark code.

Derived inputs (code files, diffs, logs) are built from the tables by the same
arithmetic; everything after that is computed another way: line windows instead of
array functions, recursion instead of folds, sparse joins instead of matrices.
"""

from __future__ import annotations

import re

from hunkwise.functions import rules as R
from hunkwise.operators import cases, search
from hunkwise.plans import queries as Q
from hunkwise.sources import samples as S


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(texts: list[str]) -> str:
    return "[" + ", ".join(lit(t) for t in texts) + "]"


def pick(texts: list[str], index: str) -> str:
    return f"list_extract({arr(texts)}, ({index})::INT + 1)"


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    CTE[name] = (tuple(needs.split()), sql)


def with_ctes(sql: str, needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in CTE[name][0]:
            visit(n)
        order.append(name)

    for n in needs.split():
        visit(n)
    # Steps that several others read are made once, whatever the plan.
    shared = ("dl", "nl", "diff_rule_unique")
    body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in shared else ''}({CTE[n][1]})" for n in order)
    again = "RECURSIVE " if any(re.search(rf"\b{n}\b", CTE[n][1]) for n in order) else ""
    return f"WITH {again}{body}\n{sql}" if order else sql


def split_cte(name: str, source: str, keys: str, text: str) -> None:
    """Numbered lines (n from 1) of a text column; no empty line after a last break."""
    cte(
        name,
        source,
        f"""SELECT {keys}, n, line FROM (
            SELECT {keys}, unnest(parts) AS line, generate_subscripts(parts, 1) AS n, len(parts) AS total
            FROM (SELECT *, string_split({text}, chr(10)) AS parts FROM {source}))
        WHERE NOT (n = total AND line = '')""",
    )


# --- derived inputs ---

cte(
    "o",
    "",
    """SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS dt,
        'r' || o_custkey || '/f' || o_orderkey ||
        CASE WHEN o_orderkey % 19 = 0 THEN '/.env.example' WHEN o_orderkey % 23 = 0 THEN '.js' ELSE '.py' END AS file
    FROM orders""",
)
cte(
    "code",
    "o",
    f"""SELECT k AS diff_id, 'r' || c AS repo, file,
        replace({pick([t for t, _ in S.TEMPLATES], f"k % {S.N}")}, '{{K}}', k::VARCHAR) AS source FROM o""",
)
split_cte("code_line", "code", "diff_id, repo, file", "source")
cte("doc", "", "SELECT doc_id AS diff_id, 'doc' || doc_id || '.txt' AS file, text FROM documents")
split_cte("doc_line", "doc", "diff_id, file", "text")

_two, _one = S.diff_pieces()["two"], S.diff_pieces()["one"]
cte(
    "raw",
    "o",
    f"""SELECT k AS diff_id, 'r' || c AS repo,
        CASE WHEN k % 3 = 0 THEN 'From: someone' || chr(10) ELSE '' END
        || 'diff --git a/' || CASE WHEN k % 13 = 0 THEN 'old/' ELSE '' END || file || ' b/' || file || chr(10)
        || CASE WHEN k % 11 = 0 THEN 'new file mode 100644' WHEN k % 17 = 3 THEN 'deleted file mode 100644'
                ELSE 'index 1..2 100644' END || chr(10)
        || '--- a' || chr(10) || '+++ b' || chr(10)
        || replace({pick(_two, f"k % {S.N}")}, '{{K}}', k::VARCHAR)
        || CASE WHEN k % 19 = 1 THEN 'diff --git a/x/moved.py b/y/moved.py' || chr(10) || 'rename from x' || chr(10) ELSE '' END
        || 'diff --git a/' || other || ' b/' || other || chr(10) || 'index 3..4' || chr(10)
        || replace({pick(_one, f"(k * 3 + 5) % {S.N}")}, '{{K}}', k::VARCHAR)
        || CASE WHEN k % 29 = 2 THEN 'diff --git "a/q u" "b/q u"' || chr(10) || '+quoted = 1' || chr(10) ELSE '' END AS raw
    FROM (SELECT *, CASE WHEN k % 5 = 0 THEN file ELSE 'lib/g' || k || '.py' END AS other FROM o)""",
)
split_cte("raw_line", "raw", "diff_id, repo", "raw")

# --- parsing by line windows ---

_FILE = "'^diff --git a/(.+?) b/(.+?)$'"
_HUNK = r"'^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@(.*)'"
cte(
    "in_file",
    "raw_line",
    f"""SELECT * FROM (SELECT *, regexp_matches(line, {_FILE}) AS is_file,
        sum(regexp_matches(line, {_FILE})::INT) OVER (PARTITION BY diff_id ORDER BY n) AS fseq FROM raw_line)
    WHERE fseq > 0""",
)
cte(
    "in_hunk",
    "in_file",
    f"""SELECT *, sum(is_hunk::INT) OVER (PARTITION BY diff_id, fseq ORDER BY n) AS hseq
    FROM (SELECT *, NOT is_file AND regexp_matches(line, {_HUNK}) AS is_hunk FROM in_file)""",
)
cte(
    "file_head",
    "in_hunk",
    f"""SELECT diff_id, fseq, string_agg(line, chr(10) ORDER BY n) AS raw_header,
        bool_or(contains(line, 'new file mode')) AS is_new, bool_or(contains(line, 'deleted file mode')) AS is_deleted,
        max(CASE WHEN is_file THEN regexp_extract(line, {_FILE}, 1) END) AS a,
        max(CASE WHEN is_file THEN regexp_extract(line, {_FILE}, 2) END) AS b
    FROM in_hunk WHERE hseq = 0 GROUP BY ALL""",
)


def _num(group: int) -> str:
    return f"regexp_extract(line, {_HUNK}, {group})"


cte(
    "hunk_head",
    "in_hunk",
    f"""SELECT diff_id, fseq, hseq, {_num(1)}::BIGINT AS old_start,
        CASE WHEN {_num(2)} = '' THEN 1 ELSE {_num(2)}::BIGINT END AS old_count, {_num(3)}::BIGINT AS new_start,
        CASE WHEN {_num(4)} = '' THEN 1 ELSE {_num(4)}::BIGINT END AS new_count, trim({_num(5)}) AS header
    FROM in_hunk WHERE is_hunk""",
)
cte(
    "dl",
    "in_hunk file_head hunk_head",
    """SELECT diff_id, repo, (dense_rank() OVER (PARTITION BY diff_id ORDER BY fseq) - 1)::INT AS file_no,
        b AS filename, CASE WHEN a <> b THEN a ELSE '' END AS old_filename, is_new, is_deleted, raw_header,
        (dense_rank() OVER (PARTITION BY diff_id, fseq ORDER BY hseq) - 1)::INT AS hunk_no,
        old_start, old_count, new_start, new_count, header, line_no::INT AS line_no, line
    FROM (SELECT diff_id, repo, fseq, hseq, line,
            row_number() OVER (PARTITION BY diff_id, fseq, hseq ORDER BY n) - 1 AS line_no
          FROM in_hunk WHERE hseq > 0 AND NOT is_hunk)
    JOIN file_head USING (diff_id, fseq) JOIN hunk_head USING (diff_id, fseq, hseq)
    WHERE line_no < 3000""",
)
cte(
    "nl",
    "dl",
    """SELECT diff_id, file_no, filename, hunk_no, line_no,
        CASE WHEN line LIKE '+%' THEN -1 ELSE old_start + count(*) FILTER (line NOT LIKE '+%') OVER w END::BIGINT AS old_line,
        CASE WHEN line LIKE '-%' THEN -1 ELSE new_start + count(*) FILTER (line NOT LIKE '-%') OVER w END::BIGINT AS new_line
    FROM dl WINDOW w AS (PARTITION BY diff_id, file_no, hunk_no ORDER BY line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
cte(
    "diff_added",
    "dl",
    """SELECT diff_id, file_no, file, hunk_no, pos, new_line, substr(line, 2) AS content
    FROM (SELECT diff_id, file_no, filename AS file, hunk_no, line_no AS pos, line,
            (new_start + count(*) FILTER (line NOT LIKE '-%') OVER w)::BIGINT AS new_line
          FROM dl WINDOW w AS (PARTITION BY diff_id, file_no, hunk_no ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE line LIKE '+%' AND line NOT LIKE '+++%'""",
)
# an added line that itself starts with ++ looks like a file header and is skipped
cte(
    "code_added",
    "code_line",
    """SELECT diff_id, 0 AS file_no, file, 0 AS hunk_no, n AS pos, n AS new_line, line AS content
    FROM code_line WHERE line NOT LIKE '++%'""",
)
cte(
    "doc_added",
    "doc_line",
    """SELECT diff_id, 0 AS file_no, file, 0 AS hunk_no, n AS pos, n AS new_line, line AS content
    FROM doc_line WHERE line NOT LIKE '++%'""",
)

# --- rules ---

_KW = r"\b(SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|EXEC|EXECUTE|UNION)\b"
_SQL = (
    rf"""(?i)f["'].*{_KW}.*\{{.*\}}""",
    rf"""(?i)["'].*{_KW}.*["']\s*\.format\(""",
    rf"""(?i)["'].*{_KW}.*%[sd].*["']\s*%""",
    rf"""(?i)["'].*{_KW}.*["']\s*\+""",
)
_SECRET = (
    "AKIA[0-9A-Z]{16}",
    "ghp_[A-Za-z0-9]{36}",
    "sk-[A-Za-z0-9]{32,}",
    "-----BEGIN[^-]+PRIVATE KEY-----",
    """["'][A-Fa-f0-9]{40,}["']""",
    r"""(?i)(token|secret|password|passwd|api_key|apikey)[a-z0-9_]*["']?\s*[:=]\s*["'][^"'\s]{16,}["']""",
)


def _case(patterns, labels, template) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(content, {lit(p)}) THEN {lit(template.format(label=l))}" for p, l in zip(patterns, labels)
    )
    return f"CASE {arms} END"


def rules_cte(name: str, added: str) -> None:
    """Findings with the columns that fix their order: file_no, fam, hunk_no, pos."""
    tail = "'rule' AS source, 1.0::DOUBLE AS confidence, '' AS reasoning_trace"
    own = "diff_id AS review_id, file_no, file, hunk_no, pos, new_line::BIGINT AS line_start, new_line::BIGINT AS line_end"
    cte(
        name,
        added,
        f"""SELECT * FROM (
            SELECT {own}, 0 AS fam, 'critical' AS severity, 'security' AS category,
                {_case(_SECRET, [n for n, _ in R.SECRET_PATTERNS], R.SECRET_EXPLANATION)} AS explanation,
                {lit(R.SECRET_FIX)} AS suggested_fix, {tail}
            FROM {added} WHERE NOT ends_with(file, '.env.example')
            UNION ALL
            SELECT {own}, 1, 'high', 'security',
                {_case(_SQL, [n for n, _ in R.SQL_PATTERNS], R.SQL_EXPLANATION)}, {lit(R.SQL_FIX)}, {tail}
            FROM {added}
            UNION ALL
            SELECT {own}, 2, 'medium', 'bug',
                CASE WHEN regexp_matches(content, '^\\s*except\\s*:') THEN {lit(R.BARE_EXPLANATION)}
                     WHEN regexp_matches(content, '^\\s*except\\s+(Exception|BaseException)\\s*(as\\s+\\w+)?\\s*:')
                          AND following = 'pass' THEN {lit(R.SWALLOWED_EXPLANATION)} END,
                CASE WHEN regexp_matches(content, '^\\s*except\\s*:') THEN {lit(R.BARE_FIX)} ELSE {lit(R.SWALLOWED_FIX)} END,
                {tail}
            FROM (SELECT *, trim(lead(content) OVER (PARTITION BY diff_id, file_no, hunk_no ORDER BY pos)) AS following
                  FROM {added} WHERE trim(content) <> ''))
        WHERE explanation IS NOT NULL""",
    )


rules_cte("code_found", "code_added")
rules_cte("diff_found", "diff_added")
rules_cte("doc_found", "doc_added")

FOUND = "review_id, file, line_start, line_end, severity, category, explanation, source"

# --- agent findings ---


def chained(text: str, pairs) -> str:
    for pattern, replacement in pairs:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return text


_PLAIN = tuple((p, "[REDACTED]") for p in _SECRET[:5])
_TYPED = (
    (_SECRET[0], "[REDACTED_AWS_KEY]"),
    (_SECRET[1], "[REDACTED_GITHUB_TOKEN]"),
    (_SECRET[2], "[REDACTED_API_KEY]"),
    (_SECRET[3], "[REDACTED_PRIVATE_KEY]"),
)


def typed(text: str) -> str:
    """The quoted rule has no back reference here: one pattern per kind of quote."""
    for pattern, replacement in (
        *_TYPED,
        ('"[A-Za-z0-9+/=]{40,}"', '"[REDACTED]"'),
        ("'[A-Za-z0-9+/=]{40,}'", "'[REDACTED]'"),
    ):
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return text


cte(
    "item",
    "o",
    f"""SELECT k, file, unnest(items) AS item, generate_subscripts(items, 1) AS us
    FROM (SELECT k, file, CASE WHEN json_valid(payload) THEN json_extract(payload, '$.findings[*]') ELSE [] END AS items
          FROM (SELECT k, file, replace({pick(S.SUBMISSIONS, f"k % {len(S.SUBMISSIONS)}")}, '{{F}}', file) AS payload FROM o))""",
)
cte(
    "agent_found",
    "item",
    f"""SELECT k AS review_id, 0 AS file_no, coalesce(item->>'$.file', file) AS file, 0 AS hunk_no, us AS pos,
        (item->>'$.line_start')::BIGINT AS line_start, (item->>'$.line_end')::BIGINT AS line_end, 7 AS fam,
        item->>'$.severity' AS severity, item->>'$.category' AS category,
        {typed("coalesce(item->>'$.explanation', '')")} AS explanation,
        {typed("coalesce(item->>'$.suggested_fix', '')")} AS suggested_fix,
        'agent' AS source, (item->>'$.confidence')::DOUBLE AS confidence,
        coalesce(item->>'$.reasoning_trace', '') AS reasoning_trace
    FROM item
    WHERE coalesce(json_type(item, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT'), true) AND coalesce(try_cast(item->>'$.confidence' AS DOUBLE), 0.5) >= 0.7
        AND item->>'$.severity' IN ('critical', 'high', 'medium', 'low')
        AND item->>'$.category' IN ('bug', 'security', 'style', 'performance')
        AND item->>'$.line_start' IS NOT NULL AND item->>'$.line_end' IS NOT NULL""",
)

_SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_SRC = "CASE source WHEN 'rule' THEN 0 WHEN 'agent' THEN 1 WHEN 'llm' THEN 2 ELSE 3 END"
_ARRIVAL = "file_no, fam, hunk_no, pos"


def ranked_cte(name: str, *parts: str) -> None:
    union = " UNION ALL BY NAME ".join(f"SELECT * FROM {p}" for p in parts)
    cte(f"{name}_all", " ".join(parts), union)
    cte(
        f"{name}_unique",
        f"{name}_all",
        f"""SELECT * FROM {name}_all QUALIFY row_number() OVER (
            PARTITION BY review_id, file, line_start, line_end, category ORDER BY {_SRC}, {_ARRIVAL}) = 1""",
    )
    cte(
        f"{name}_ranked",
        f"{name}_unique",
        f"""SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {_SEV}, {_SRC}, {_ARRIVAL}) AS rank
        FROM {name}_unique""",
    )


ranked_cte("code_both", "code_found", "agent_found")
ranked_cte("diff_both", "diff_found", "agent_found")
ranked_cte("diff_rule", "diff_found")

cte("file_of", "dl", "SELECT DISTINCT diff_id, file_no, filename FROM dl")

# --- evaluation ---

_LABELS = ", ".join(
    f"({t}, {i}, {l[0]}, {lit(l[1])})" for t, (_, ls) in enumerate(S.TEMPLATES) for i, l in enumerate(ls)
)
cte(
    "code_label",
    "o",
    f"""SELECT k AS review_id, file, label_seq, line, category
    FROM o JOIN (VALUES {_LABELS}) AS v(t, label_seq, line, category) ON k % {S.N} = v.t""",
)


def greedy_cte(name: str, found: str, labels: str, keys: str) -> None:
    cte(
        f"{name}_group",
        f"{found} {labels}",
        f"""SELECT * FROM (SELECT {keys}, category, list(line_start ORDER BY {_ARRIVAL}) AS f FROM {found} GROUP BY ALL)
        FULL JOIN (SELECT {keys}, category, list({{'seq': label_seq, 'line': line}} ORDER BY label_seq) AS l
                   FROM {labels} GROUP BY ALL) USING ({keys}, category)""",
    )
    cte(
        f"{name}_step",
        f"{name}_group",
        f"""SELECT {keys}, category, f, coalesce(l, []) AS l, 0 AS i, []::BIGINT[] AS used,
            NULL::STRUCT(seq BIGINT, line BIGINT) AS hit FROM {name}_group
        UNION ALL
        SELECT {keys}, category, f, l, i + 1,
            CASE WHEN hit2 IS NULL THEN used ELSE list_append(used, hit2.seq) END, hit2
        FROM (SELECT * EXCLUDE (hit), list_filter(l, lambda x: NOT list_contains(used, x.seq) AND abs(x.line - f[i + 1]) <= 3)[1] AS hit2
              FROM {name}_step WHERE i < len(f))""",
    )
    cte(
        name,
        f"{name}_step",
        f"""SELECT {keys}, category, CASE WHEN hit IS NULL THEN 'fp' ELSE 'tp' END AS outcome, f[i] AS finding_line,
            coalesce(hit.seq, -1)::BIGINT AS label_seq, coalesce(hit.line, -1)::BIGINT AS label_line
        FROM {name}_step WHERE i > 0
        UNION ALL
        SELECT {keys}, category, 'fn', -1, x.seq, x.line FROM (
            SELECT {keys}, category, unnest(list_filter(l, lambda y: NOT list_contains(used, y.seq))) AS x
            FROM {name}_step WHERE i = coalesce(len(f), 0))""",
    )


greedy_cte("pair", "code_found", "code_label", "review_id, file")


def scores(tp: str = "true_positives", fp: str = "false_positives", fn: str = "false_negatives") -> str:
    return f"""CASE WHEN {tp} + {fp} > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 1.0::DOUBLE END AS precision_raw,
        CASE WHEN {tp} + {fn} > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 1.0::DOUBLE END AS recall_raw"""


_COUNTED = ", ".join(
    f"count(*) FILTER (outcome = '{o}') AS {n}"
    for o, n in (("tp", "true_positives"), ("fp", "false_positives"), ("fn", "false_negatives"))
)
cte(
    "detail",
    "pair code",
    f"""SELECT *, round_even(precision_raw, 3) AS precision, round_even(recall_raw, 3) AS recall
    FROM (SELECT *, {scores()} FROM (
        SELECT diff_id AS review_id, code.file, {_COUNTED}
        FROM code LEFT JOIN pair ON pair.review_id = diff_id AND pair.file = code.file GROUP BY ALL))""",
)

# --- events ---

cte("ev", "", "SELECT *, epoch_us(ts) AS us, (props->>'$.k')::INT AS kk FROM events")
cte("ev_seq", "ev", "SELECT event_id, user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev")
_WINDOW = Q.LIMIT_WINDOW * 1_000_000
cte(
    "limited",
    "ev_seq",
    f"""SELECT event_id, user_id, us, i, [us] AS live, true AS allowed FROM ev_seq WHERE i = 1
    UNION ALL
    SELECT event_id, user_id, us, i, CASE WHEN len(now) < {Q.LIMIT} THEN list_append(now, us) ELSE now END, len(now) < {Q.LIMIT}
    FROM (SELECT e.event_id, e.user_id, e.us, e.i, list_filter(p.live, lambda t: t > e.us - {_WINDOW}) AS now
          FROM limited p JOIN ev_seq e ON e.user_id = p.user_id AND e.i = p.i + 1)""",
)
cte(
    "used",
    "ev",
    """SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY review_id ORDER BY us, seq)::BIGINT AS epoch
    FROM (SELECT user_id AS review_id, event_id AS seq, us, CASE WHEN event_type = 'signup' THEN 'start' ELSE 'usage' END AS kind,
            floor(value * 100)::BIGINT AS tokens FROM ev)""",
)
cte(
    "spent",
    "used",
    """SELECT *, total_tokens * 0.001::DOUBLE / 1000.0::DOUBLE AS cost_usd FROM (
        SELECT *, coalesce(sum(tokens) FILTER (kind = 'usage') OVER w, 0)::BIGINT AS total_tokens,
            count(*) FILTER (kind = 'usage') OVER w AS api_calls
        FROM used WINDOW w AS (PARTITION BY review_id, epoch ORDER BY us, seq))""",
)
cte(
    "outcome",
    "ev",
    """SELECT group_key, us, event_id AS seq, rule_count, agent_count, had_errors,
        (rule_count = 0 AND agent_count = 0)::INT AS is_empty, had_errors::INT AS failed,
        (rule_count > 0 AND agent_count = 0 AND NOT had_errors)::INT AS rule_only
    FROM (SELECT user_id % 10 AS group_key, us, event_id, event_type = 'error' AS had_errors,
            CASE WHEN user_id % 10 = 0 OR floor(value)::BIGINT % 10 > 1 THEN 0 ELSE floor(value)::BIGINT % 10 END AS rule_count,
            CASE WHEN floor(value)::BIGINT % 10 = 1 THEN 2 ELSE 0 END AS agent_count FROM ev)""",
)
_SUMS = """sum(is_empty){over}::BIGINT AS empty_reviews, sum(failed){over}::BIGINT AS agent_failures,
    sum(rule_only){over}::BIGINT AS rule_only_reviews"""
cte(
    "call",
    "",
    """SELECT conv_id, turn, length(text) AS tokens, (conv_id + turn) % 7 = 0 AS is_submit,
        (conv_id + turn) % 5 <> 0 AS uses_tools FROM conversations WHERE role = 'assistant'""",
)
cte(
    "received",
    "ev",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'pull_request' ELSE event_type END AS kind,
        CASE WHEN kk % 5 = 0 THEN 'opened' WHEN kk % 5 = 1 THEN 'synchronize' WHEN kk % 5 = 2 THEN 'reopened' ELSE 'closed' END AS action,
        CASE WHEN kk % 11 = 0 THEN 'norepo' WHEN kk % 11 = 1 THEN 'o/a/' || user_id ELSE 'o/r' || user_id END AS full_name,
        CASE WHEN kk % 13 = 0 THEN '' ELSE 'Change ' || user_id END AS title, kk % 17 <> 0 AS complete FROM ev""",
)

# --- chunks and vectors ---

cte(
    "doc_chunk",
    "doc_line",
    """SELECT diff_id, file, ((n - 1) // 50)::INT AS chunk_no, min(n)::INT AS line_start, max(n)::INT AS line_end,
        string_agg(line, chr(10) ORDER BY n) AS content FROM doc_line GROUP BY ALL""",
)
cte(
    "top_line",
    "code_line",
    r"""SELECT *, regexp_matches(line, '^(async[ \t]+def|def|class)\b') AS is_block,
        lead(n) OVER (PARTITION BY diff_id ORDER BY n) AS next_top
    FROM code_line WHERE ends_with(file, '.py') AND regexp_matches(line, '^[^\s)\]}]')""",
)
cte("block", "top_line", "SELECT * FROM top_line WHERE is_block")
cte("first_block", "block", "SELECT diff_id, min(n) AS n FROM block GROUP BY ALL")
cte(
    "code_chunk",
    "code_line block first_block",
    r"""SELECT diff_id, repo, file, (row_number() OVER (PARTITION BY diff_id ORDER BY line_start) - 1)::INT AS chunk_no,
        type, name, line_start::INT AS line_start, line_end::INT AS line_end, content
    FROM (
        SELECT l.diff_id, repo, file, 'module_header' AS type, '' AS name, 1 AS line_start, f.n - 1 AS line_end,
            regexp_replace(string_agg(line, chr(10) ORDER BY l.n), '^\s+|\s+$', '', 'g') AS content
        FROM code_line l JOIN first_block f ON f.diff_id = l.diff_id AND l.n < f.n GROUP BY ALL HAVING content <> ''
        UNION ALL
        SELECT diff_id, repo, file, type, name, start, max(n) FILTER (NOT empty), 
            regexp_replace(string_agg(line, chr(10) ORDER BY n) FILTER (n <= last), '^\s+|\s+$', '', 'g')
        FROM (SELECT l.*, b.n AS start,
                CASE WHEN b.line LIKE 'async%' THEN 'AsyncFunctionDef' WHEN b.line LIKE 'class%' THEN 'ClassDef' ELSE 'FunctionDef' END AS type,
                regexp_extract(b.line, '(def|class)[ \t]+(\w+)', 2) AS name,
                regexp_matches(l.line, '^\s*(#.*)?$') AS empty,
                max(l.n) FILTER (NOT regexp_matches(l.line, '^\s*(#.*)?$')) OVER (PARTITION BY l.diff_id, b.n) AS last
              FROM code_line l JOIN block b ON b.diff_id = l.diff_id AND l.n >= b.n AND (b.next_top IS NULL OR l.n < b.next_top))
        GROUP BY diff_id, repo, file, type, name, start, last
        UNION ALL
        SELECT diff_id, repo, file, 'line_chunk', '', min(n), max(n), string_agg(line, chr(10) ORDER BY n)
        FROM code_line WHERE diff_id NOT IN (SELECT diff_id FROM first_block) GROUP BY diff_id, repo, file, (n - 1) // 50)""",
)


def keyed(source: str) -> str:
    return f"""SELECT *, substr(sha256(file || ':' || line_start || ':' || content), 1, 16) AS chunk_id
    FROM {source} WHERE regexp_replace(content, '\\s', '', 'g') <> ''"""


cte("doc_key", "doc_chunk", keyed("doc_chunk"))
cte("code_key", "code_chunk", keyed("code_chunk"))

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_D = search.DIMENSIONS


def vectors(name: str, texts: str, id_: str, text: str) -> None:
    cte(
        f"{name}_tf",
        texts,
        f"""SELECT {id_} AS id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {_D} AS b, count(*) AS tf
        FROM (SELECT {id_}, unnest({_WORDS.format(text)}) AS w FROM {texts}) GROUP BY ALL""",
    )


def weighted(name: str, idf: str) -> None:
    cte(
        name,
        f"{name}_tf {idf}",
        f"""SELECT id, b, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w
        FROM (SELECT id, b, tf * idf AS w FROM {name}_tf JOIN {idf} USING (b))""",
    )


def idf_cte(name: str, tf: str, texts: str) -> None:
    cte(
        name,
        f"{tf} {texts}",
        f"""SELECT b, ln((1.0::DOUBLE + (SELECT count(*) FROM {texts})) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
        FROM {tf} GROUP BY ALL""",
    )


cte("bench", "", "SELECT item_id AS query_id, text FROM benchmark")
vectors("doc_vec", "doc_key", "chunk_id", "content")
idf_cte("doc_idf", "doc_vec_tf", "doc_key")
weighted("doc_vec", "doc_idf")
vectors("bench_vec", "bench", "query_id", "text")
weighted("bench_vec", "doc_idf")

cte(
    "asked",
    "dl",
    """SELECT diff_id || ':' || file_no AS query_id, diff_id, file_no, repo, filename, string_agg(t, ' ' ORDER BY hunk_no, line_no) AS query
    FROM (SELECT *, trim(substr(line, 2)) AS t, row_number() OVER (PARTITION BY diff_id, file_no ORDER BY hunk_no, line_no) AS i
          FROM dl WHERE line LIKE '+%' AND line NOT LIKE '+++%')
    WHERE i <= 10 GROUP BY ALL HAVING length(query) >= 10""",
)
vectors("code_vec", "code_key", "chunk_id", "content")
idf_cte("code_idf", "code_vec_tf", "code_key")
weighted("code_vec", "code_idf")
vectors("ask_vec", "asked", "query_id", "query")
weighted("ask_vec", "code_idf")
cte(
    "context",
    "asked code_key ask_vec code_vec",
    """SELECT diff_id, file_no, string_agg('--- ' || file || ' (similarity: ' || round(score::DECIMAL(9, 6), 2)::DECIMAL(9, 2) || ') ---'
            || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM (SELECT q.query_id, q.diff_id, q.file_no, q.filename, c.chunk_id, c.file, c.content, coalesce(round(d.dot, 6), 0) AS score
                FROM asked q JOIN code_key c ON c.repo = q.repo
                LEFT JOIN (SELECT x.id AS query_id, y.id AS chunk_id, sum(x.w * y.w) AS dot
                           FROM ask_vec x JOIN asked a ON a.query_id = x.id
                           JOIN code_key k ON k.repo = a.repo JOIN code_vec y ON y.id = k.chunk_id AND y.b = x.b GROUP BY ALL) d
                ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id))
    WHERE rank <= 3 AND file <> filename GROUP BY ALL""",
)
cte(
    "shown",
    "dl",
    """SELECT diff_id, file_no, filename, hunk_no, sum(size) OVER (PARTITION BY diff_id, file_no ORDER BY hunk_no) - size AS before,
        count(*) OVER (PARTITION BY diff_id, file_no) AS hunks, text
    FROM (SELECT diff_id, file_no, filename, hunk_no, count(*) AS size,
            '@@ -' || old_start || ',' || old_count || ' +' || new_start || ',' || new_count || ' @@ ' || header || chr(10)
            || string_agg(line, chr(10) ORDER BY line_no) AS text
          FROM dl GROUP BY diff_id, file_no, filename, hunk_no, old_start, old_count, new_start, new_count, header)""",
)


def reader(limit: int) -> str:
    """Hunks up to the first that starts after ``limit`` lines, then a notice."""
    return f"""SELECT diff_id, file_no, filename, string_agg(text, chr(10) ORDER BY hunk_no) FILTER (before <= {limit})
        || CASE WHEN count(*) FILTER (before > {limit}) > 0
           THEN chr(10) || '[... ' || max(hunks) || ' hunks total, truncated ...]' ELSE '' END AS text
    FROM shown GROUP BY ALL"""


cte("reader_text", "shown", reader(500))
cte(
    "noted",
    "diff_found",
    f"""SELECT review_id AS diff_id, file_no,
        string_agg('- Line ' || line_start || ': [' || severity || '] ' || explanation, chr(10) ORDER BY {_ARRIVAL}) AS items
    FROM diff_found GROUP BY ALL""",
)
cte(
    "edge",
    "code",
    r"""SELECT diff_id, repo, file, module, name, alias,
        CASE WHEN form = 'from' THEN 'from ' || module || ' import ' || name ELSE 'import ' || module END
        || CASE WHEN alias <> '' THEN ' as ' || alias ELSE '' END AS statement
    FROM (SELECT diff_id, repo, file, form,
            CASE WHEN form = 'from' THEN module ELSE regexp_extract(item, '^([\w.*]+)', 1) END AS module,
            CASE WHEN form = 'from' THEN regexp_extract(item, '^([\w.*]+)', 1) ELSE '' END AS name,
            regexp_extract(item, '\sas\s+(\w+)$', 1) AS alias
          FROM (SELECT diff_id, repo, file, form, module, trim(unnest(string_split(regexp_replace(names, '\s+', ' ', 'g'), ','))) AS item
                FROM (SELECT diff_id, repo, file, 'plain' AS form, '' AS module,
                        unnest(regexp_extract_all(source, '(?m)(?:^|;)[ \t]*import[ \t]+([^\n#;]+)', 1)) AS names FROM code
                      UNION ALL
                      SELECT diff_id, repo, file, 'from', regexp_extract(s, '^from[ \t]+\.*([\w.]*)', 1),
                        regexp_replace(regexp_extract(s, 'import[ \t]*\(?([^)]*)', 1), '#[^\n]*', '', 'g')
                      FROM (SELECT diff_id, repo, file,
                              unnest(regexp_extract_all(source, '(?m)(?:^|;)[ \t]*(from[ \t]+[\w.]+[ \t]+import[ \t]*(?:\([^)]*\)|[^\n#;]+))', 1)) AS s FROM code)))
          WHERE item <> '')""",
)

# --- the queries ---

ORACLE: dict[str, str] = {}


def oracle(name: str, needs: str, sql: str) -> None:
    ORACLE[name] = with_ctes(sql, needs)


oracle(
    "parse_diff",
    "dl",
    """SELECT diff_id, file_no, filename, old_filename, is_new, is_deleted, hunk_no, old_start, old_count,
        new_start, new_count, header, line_no, line FROM dl""",
)
oracle(
    "parse_diff_files",
    "dl",
    """SELECT diff_id, file_no, filename, old_filename, is_new, is_deleted, raw_header, count(DISTINCT hunk_no)::INT AS hunks
    FROM dl GROUP BY ALL""",
)
oracle(
    "lines_as_added",
    "doc_line",
    """SELECT diff_id, file AS filename, count(*) OVER (PARTITION BY diff_id) AS new_count, (n - 1)::INT AS line_no,
        '+' || line AS line FROM doc_line""",
)
oracle("number_lines", "nl", "SELECT diff_id, file_no, hunk_no, line_no, old_line, new_line FROM nl")
oracle(
    "added_lines",
    "diff_added",
    "SELECT diff_id, file_no, file AS filename, hunk_no, new_line, content FROM diff_added",
)
oracle(
    "reconstruct_source",
    "dl",
    """SELECT diff_id, file_no, filename, coalesce(string_agg(
            CASE WHEN (line LIKE '+%' AND line NOT LIKE '+++%') OR line LIKE ' %' THEN substr(line, 2) ELSE line END,
            chr(10) ORDER BY hunk_no, line_no) FILTER (line NOT LIKE '-%'), '') AS source
    FROM dl GROUP BY diff_id, file_no, filename""",
)
oracle("format_diff", "shown", reader(12))
ORACLE["truncate_bytes"] = f"""WITH c AS (
        SELECT doc_id, unnest(parts) AS ch, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(text, '') AS parts FROM documents)),
    b AS (SELECT doc_id, i, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS bytes FROM c),
    m AS (SELECT doc_id, max(bytes) AS total, coalesce(max(i) FILTER (bytes <= {Q.BYTES}), 0) AS fit,
            coalesce(max(bytes) FILTER (bytes <= {Q.BYTES}), 0) AS fit_bytes FROM b GROUP BY ALL)
    SELECT d.doc_id, CASE WHEN m.total > {Q.BYTES} THEN left(d.text, fit)
        || CASE WHEN fit_bytes < {Q.BYTES} THEN chr(65533) ELSE '' END || {lit(Q.TRUNCATED)} ELSE d.text END AS text
    FROM documents d LEFT JOIN m USING (doc_id)"""

oracle("scan_sql_injection", "code_found", f"SELECT {FOUND} FROM code_found WHERE fam = 1")
oracle("scan_exceptions", "code_found", f"SELECT {FOUND} FROM code_found WHERE fam = 2")
oracle("scan_secrets", "doc_found", f"SELECT {FOUND} FROM doc_found WHERE fam = 0")
oracle("run_rules", "code_found", f"SELECT {FOUND}, suggested_fix FROM code_found")
oracle("run_rules_diffs", "diff_found", f"SELECT file_no, {FOUND} FROM diff_found")
oracle(
    "blocklist_screen",
    "code",
    "SELECT diff_id, file, CASE "
    + " ".join(f"WHEN contains(source, {lit(t)}) THEN {lit(t)}" for t in R.BLOCKED_TERMS)
    + " END AS blocked_by FROM code",
)
_SCREEN = (
    r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+instructions",
    r"(?i)you\s+are\s+now\s+(a\s+)?(different|new)\s+(ai|assistant|bot)",
    r"(?i)system\s*:\s*",
    r"(?i)<\|(system|im_start|endoftext)\|>",
    r"(?i)IMPORTANT:\s*(ignore|disregard|forget)",
    r"(?i)(do\s+not|don't)\s+(review|analyze|check)\s+(this|the)\s+code",
)
_stages = [f"s0 AS (SELECT conv_id, turn, text || {pick(S.SCREEN_PHRASES, f'(conv_id + turn) % {len(S.SCREEN_PHRASES)}')} AS t, 0 AS hits FROM conversations)"]
for _i, _p in enumerate(_SCREEN):
    _stages.append(
        f"s{_i + 1} AS (SELECT conv_id, turn, regexp_replace(t, {lit(_p)}, {lit(R.INJECTION_MARK)}, 'g') AS t, "
        f"hits + regexp_matches(t, {lit(_p)})::INT AS hits FROM s{_i})"
    )
ORACLE["screen_injection"] = (
    "WITH " + ",\n".join(_stages) + f"\nSELECT conv_id, turn, hits, {lit(R.UNTRUSTED_OPEN)} || chr(10) || t || chr(10) || "
    f"{lit(R.UNTRUSTED_CLOSE)} AS clean FROM s{len(_SCREEN)}"
)
ORACLE["redact_plain"] = f"SELECT doc_id, {chained('text', _PLAIN)} AS text FROM documents"
ORACLE["redact_typed"] = f"SELECT doc_id, {typed('text')} AS text FROM documents"
oracle("confidence_gate", "agent_found", f"SELECT {FOUND}, suggested_fix, confidence, reasoning_trace FROM agent_found")

oracle("merge_findings", "code_both_all", f"SELECT {FOUND}, confidence FROM code_both_all")
oracle("dedupe_findings", "code_both_unique", f"SELECT {FOUND}, confidence FROM code_both_unique")
oracle("rank_findings", "code_both_ranked", f"SELECT {FOUND}, rank FROM code_both_ranked")
oracle(
    "attach_findings",
    "nl diff_rule_unique",
    """SELECT diff_id, nl.file_no, nl.hunk_no, line_no, new_line, coalesce(severity, '') AS severity, coalesce(category, '') AS category
    FROM nl LEFT JOIN diff_rule_unique f ON f.review_id = nl.diff_id AND f.file = nl.filename AND f.line_end = nl.new_line""",
)
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
oracle(
    "severity_rollup",
    "o diff_both_unique file_of",
    f"""SELECT *, substr(sha256(owner || '/' || repo || '#' || pr_number || '@' || created_at), 1, 12) AS uid
    FROM (SELECT k AS review_id, 'o' || (c % 7) AS owner, 'r' || c AS repo, k AS pr_number, 'Change ' || k AS pr_title,
            strftime(dt, '%Y-%m-%d') AS created_at, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
            coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(files, 0) AS files_analyzed
          FROM o LEFT JOIN (SELECT review_id, {_COUNTS} FROM diff_both_unique GROUP BY ALL) f ON f.review_id = k
          LEFT JOIN (SELECT diff_id, count(*) AS files FROM file_of GROUP BY ALL) n ON n.diff_id = k)""",
)
oracle(
    "review_detail",
    "o code_both_ranked",
    """SELECT k AS review_id, 'o' || (c % 7) AS owner, 'r' || c AS repo, 'Change ' || k AS pr_title, coalesce(rank, 0) AS rank,
        coalesce(f.file, '') AS file, coalesce(severity, '') AS severity, coalesce(category, '') AS category,
        coalesce(explanation, '') AS explanation, coalesce(source, '') AS source, coalesce(line_start, 0) AS line_start
    FROM o LEFT JOIN code_both_ranked f ON f.review_id = k""",
)
oracle(
    "stored_reviews",
    "o diff_rule_unique file_of",
    """SELECT k AS review_id, 'o' || (c % 7) AS owner, 'r' || c AS repo, k AS pr_number, strftime(dt, '%Y') || '-01-01' AS day,
        coalesce(files, 0) AS files, coalesce(findings, 0) AS findings
    FROM o LEFT JOIN (SELECT review_id, count(*) AS findings FROM diff_rule_unique GROUP BY ALL) f ON f.review_id = k
    LEFT JOIN (SELECT diff_id, count(*) AS files FROM file_of GROUP BY ALL) n ON n.diff_id = k""",
)
oracle(
    "stored_detail",
    "dl",
    """SELECT diff_id AS review_id, 'Change ' || diff_id AS pr_title, file_no, filename, count(DISTINCT hunk_no)::INT AS hunks,
        raw_header FROM dl GROUP BY ALL""",
)
oracle(
    "read_diffs",
    "o dl",
    """SELECT 'r' || c AS repo, count(*) AS files, sum(hunks)::BIGINT AS hunks, (count(*) - 1 + any_value(0))::INT AS last_file_no
    FROM o JOIN (SELECT diff_id, file_no, count(DISTINCT hunk_no) AS hunks FROM dl GROUP BY ALL) f ON f.diff_id = o.k GROUP BY ALL""",
)
oracle(
    "stored_page",
    "o",
    f"""SELECT k AS review_id, 'o' || (c % 7) AS owner, 'r' || c AS repo, k AS pr_number, strftime(date_trunc('year', dt), '%Y-%m-%d') AS day
    FROM o ORDER BY day DESC, k LIMIT {Q.PAGE} OFFSET {Q.PAGE}""",
)
_SIDE = ", ".join(
    f"({t}, {i}, {l[0]}, {lit(l[1])}, {lit(l[2])}, {lit(l[3])})" for t, (_, ls) in enumerate(S.TEMPLATES) for i, l in enumerate(ls)
)
oracle(
    "read_labels",
    "o",
    f"""SELECT 'r' || c AS repo, (row_number() OVER (PARTITION BY c ORDER BY k, n) - 1)::INT AS label_seq, line::BIGINT AS line,
        category, severity, label
    FROM o JOIN (VALUES {_SIDE}) AS v(t, n, line, category, severity, label) ON k % {S.N} = v.t""",
)
ORACLE["page_links"] = """SELECT page_id, (generate_subscripts(links, 1) - 1)::INT AS link_no, unnest(links) AS target
    FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"''>]*)["'']', 1) AS links FROM pages)"""
oracle(
    "file_badges",
    "file_of diff_rule_unique",
    f"""SELECT diff_id, file_no, filename, regexp_extract(filename, '([^/]*)$', 1) AS base_name, coalesce(n, 0) AS findings,
        CASE best WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE '' END AS highest
    FROM file_of LEFT JOIN (SELECT review_id, file, count(*) AS n, min({_SEV}) AS best FROM diff_rule_unique GROUP BY ALL) f
        ON f.review_id = diff_id AND f.file = filename""",
)
_BODY = """'**[' || upper(severity) || '] ' || category || '**: ' || explanation
    || CASE WHEN suggested_fix <> '' THEN chr(10) || chr(10) || 'Suggested fix: ' || suggested_fix ELSE '' END"""
oracle(
    "report_comments",
    "code_both_unique",
    f"""SELECT review_id, file AS path, line_end AS line, CASE WHEN line_start <> line_end THEN line_start ELSE 0 END AS start_line,
        {_BODY} AS body FROM code_both_unique WHERE severity IN ('critical', 'high')""",
)
oracle(
    "report_payload",
    "code_both_ranked",
    f"""SELECT review_id, 0::BIGINT AS page_no, count(c)::INT AS comments,
        '{{"event":"COMMENT","body":"Code review: ' || count(*) || ' finding(s) across this PR.","comments":['
        || coalesce(string_agg(c, ',' ORDER BY rank), '') || ']}}' AS payload
    FROM (SELECT review_id, rank, CASE WHEN severity IN ('critical', 'high') THEN
            '{{"path":' || to_json(file) || ',"line":' || line_end || ',"body":' || to_json({_BODY})
            || CASE WHEN line_start <> line_end THEN ',"start_line":' || line_start ELSE '' END || '}}' END AS c
          FROM code_both_ranked) GROUP BY review_id""",
)
oracle(
    "review_json_roundtrip",
    "code_both_all",
    f"SELECT {FOUND}, suggested_fix, confidence, reasoning_trace FROM code_both_all",
)

oracle(
    "match_labels",
    "pair",
    "SELECT review_id, file, category, outcome, finding_line, label_seq, label_line FROM pair",
)
oracle("eval_metrics", "detail", "SELECT * FROM detail")
oracle(
    "eval_total",
    "detail",
    f"""SELECT *, round_even(precision_raw, 3) AS precision, round_even(recall_raw, 3) AS recall, round_even(f1_raw, 3) AS f1
    FROM (SELECT *, CASE WHEN precision_raw + recall_raw > 0
            THEN 2 * precision_raw * recall_raw / (precision_raw + recall_raw) ELSE 0.0::DOUBLE END AS f1_raw
          FROM (SELECT *, {scores()} FROM (SELECT count(*) AS total_fixtures, sum(true_positives)::BIGINT AS true_positives,
              sum(false_positives)::BIGINT AS false_positives, sum(false_negatives)::BIGINT AS false_negatives FROM detail)))""",
)
oracle(
    "eval_levels",
    "detail",
    f"""SELECT repo, file, level, files, true_positives, false_positives, false_negatives,
        round_even(precision_raw, 3) AS precision, round_even(recall_raw, 3) AS recall,
        round_even(CASE WHEN precision_raw + recall_raw > 0
            THEN 2 * precision_raw * recall_raw / (precision_raw + recall_raw) ELSE 0.0::DOUBLE END, 3) AS f1
    FROM (SELECT *, {scores()} FROM (
        SELECT coalesce(repo, '') AS repo, coalesce(file, '') AS file, (grouping(repo) + grouping(file))::INT AS level,
            count(*) AS files, sum(true_positives)::BIGINT AS true_positives, sum(false_positives)::BIGINT AS false_positives,
            sum(false_negatives)::BIGINT AS false_negatives
        FROM (SELECT *, split_part(file, '/', 1) AS repo FROM detail) GROUP BY GROUPING SETS ((repo, file), (repo), ())))""",
)
# a document is flagged or not
oracle(
    "label_eval",
    "doc_found",
    f"""SELECT *, round_even(precision_raw, 3) AS precision, round_even(recall_raw, 3) AS recall
    FROM (SELECT *, {scores()} FROM (
        SELECT review_id, (toxic = 1 AND total > 0)::BIGINT AS true_positives,
            (toxic <> 1 AND total > 0)::BIGINT AS false_positives,
            (toxic = 1 AND total = 0)::BIGINT AS false_negatives
        FROM (SELECT doc_id AS review_id, toxic, count(line_start) AS total
              FROM labels LEFT JOIN (SELECT * FROM doc_found WHERE fam = 0) f ON f.review_id = doc_id GROUP BY ALL)))""",
)
oracle(
    "acceptance_rate",
    "ev",
    """SELECT user_id AS review, count(*) AS total_posted, count(*) FILTER (event_type = 'click') AS resolved,
        count(*) FILTER (event_type = 'error') AS dismissed, count(*) FILTER (event_type IS NULL) AS unknown,
        count(*) FILTER (event_type = 'click')::DOUBLE / count(*) AS acceptance_rate
    FROM (SELECT p.user_id, p.kk, r.event_type
          FROM (SELECT user_id, kk, max(us) AS us FROM ev WHERE event_type IN ('purchase', 'view') GROUP BY ALL) p
          LEFT JOIN ev r ON r.user_id = p.user_id AND r.kk = p.kk AND r.event_type IN ('click', 'error') AND r.us >= p.us
          QUALIFY row_number() OVER (PARTITION BY p.user_id, p.kk ORDER BY r.us DESC, r.event_id DESC) = 1)
    GROUP BY user_id""",
)

oracle("rate_limit", "limited", """SELECT event_id, user_id, us AS "at", allowed FROM limited""")
oracle(
    "quota_remaining",
    "ev limited",
    f"""SELECT p.event_id AS probe_id, p.user_id, greatest(0, {Q.LIMIT} - count(a.us))::BIGINT AS remaining
    FROM ev p LEFT JOIN (SELECT user_id, us FROM limited WHERE allowed) a
        ON a.user_id = p.user_id AND a.us > p.us - {_WINDOW} AND a.us <= p.us
    GROUP BY p.event_id, p.user_id""",
)
oracle(
    "usage_ledger",
    "spent",
    """SELECT review_id, seq, epoch, total_tokens, api_calls, cost_usd, NOT cost_usd > 0.05::DOUBLE AS within_cap FROM spent""",
)
oracle(
    "usage_totals",
    "spent",
    """SELECT review_id, total_tokens, api_calls, cost_usd, us - began AS duration_us
    FROM (SELECT *, min(us) OVER (PARTITION BY review_id, epoch) AS began FROM spent)
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY us DESC, seq DESC) = 1""",
)
oracle(
    "empty_rate_monitor",
    "outcome",
    f"""SELECT *, total_reviews >= 10 AND empty_reviews::DOUBLE / total_reviews > 0.8::DOUBLE AS alarm
    FROM (SELECT group_key, seq, count(*) OVER w AS total_reviews, {_SUMS.format(over=" OVER w")}
          FROM outcome WINDOW w AS (PARTITION BY group_key ORDER BY us, seq))""",
)
oracle(
    "outcome_counts",
    "outcome",
    f"SELECT group_key, count(*) AS total_reviews, {_SUMS.format(over='')} FROM outcome GROUP BY group_key",
)
oracle(
    "turn_budget",
    "call",
    f"""SELECT conv_id, turn, tokens_before, calls_before, kept, kept AND is_submit AS gives_findings
    FROM (SELECT *, calls_before < 5 AND tokens_before < {Q.TURN_TOKENS} AND ends_before = 0 AS kept
          FROM (SELECT *, coalesce(sum(tokens) OVER w, 0)::BIGINT AS tokens_before, count(*) OVER w AS calls_before,
                    count(*) FILTER (is_submit OR NOT uses_tools) OVER w AS ends_before
                FROM call WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""",
)

oracle(
    "chunk_lines",
    "doc_chunk",
    "SELECT diff_id, chunk_no, 'line_chunk' AS type, line_start, line_end, content FROM doc_chunk",
)
oracle(
    "chunk_blocks",
    "code_chunk",
    "SELECT diff_id, file, chunk_no, type, name, line_start, line_end, content FROM code_chunk",
)
oracle("chunk_keys", "doc_key", "SELECT diff_id, chunk_no, chunk_id FROM doc_key")
oracle(
    "upsert_chunks",
    "code_key",
    """SELECT repo, substr(sha256(file || ':' || line_start || ':' || content), 1, 16) AS chunk_id, file, line_start,
        max(batch_no) AS batch_no
    FROM (SELECT repo, CASE WHEN diff_id % 3 = 0 THEN 'setup.py' ELSE file END AS file, line_start, batch_no,
            content || CASE WHEN batch_no = 2 AND diff_id % 2 = 0 THEN ' #' ELSE '' END AS content
          FROM code_key CROSS JOIN (VALUES (1), (2)) AS b(batch_no)) GROUP BY ALL""",
)
oracle(
    "history_docs",
    "code_both_unique",
    """SELECT review_id, 'Past finding in ' || file || ': [' || severity || '] ' || category || ' — ' || explanation AS content,
        file, 'past_finding' AS type, line_start, line_end FROM code_both_unique""",
)
ORACLE["tfidf_top_terms"] = f"""WITH t AS (
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format("text")}) AS term FROM documents) GROUP BY ALL),
    i AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM t GROUP BY ALL),
    w AS (SELECT doc_id, term, round(tf * idf, 6) AS weight FROM t JOIN i USING (term))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INT AS rank, term, weight
    FROM w QUALIFY rank <= 5"""
ORACLE["exact_neighbours"] = f"""WITH s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
            round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score
    FROM s QUALIFY rank <= {Q.NEIGHBOURS}"""
ORACLE["top_k_similar"] = """WITH s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
            round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings c)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score
    FROM s QUALIFY rank <= 3"""
oracle(
    "text_search",
    "bench doc_key bench_vec doc_vec",
    """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score
    FROM (SELECT q.query_id, c.chunk_id, coalesce(round(dot, 6), 0) AS score
          FROM bench q CROSS JOIN doc_key c
          LEFT JOIN (SELECT x.id AS query_id, y.id AS chunk_id, sum(x.w * y.w) AS dot
                     FROM bench_vec x JOIN doc_vec y USING (b) GROUP BY ALL) d USING (query_id, chunk_id))
    QUALIFY rank <= 3""",
)
oracle("retrieve_context", "context", "SELECT diff_id, file_no, context FROM context")
_intro = cases.INTRO.split("%s")
oracle(
    "assemble_case",
    "reader_text context noted",
    f"""SELECT diff_id, file_no, filename, {lit(_intro[0])} || filename || {lit(_intro[1])} || text || {lit(_intro[2])}
        || CASE WHEN context IS NULL THEN '' ELSE {lit(cases.CONTEXT_TITLE)} || context END
        || CASE WHEN items IS NULL THEN '' ELSE {lit(cases.RULES_TITLE)} || items END || {lit(cases.CLOSING)} AS case_text
    FROM reader_text LEFT JOIN context USING (diff_id, file_no) LEFT JOIN noted USING (diff_id, file_no)""",
)
oracle("import_edges", "edge", "SELECT diff_id, file, module, name, alias, statement FROM edge")
oracle("dependents", "edge", "SELECT repo, module, count(DISTINCT file) AS files FROM edge GROUP BY ALL")

cte(
    "module",
    "",
    """SELECT repo, key, repo || '/f' || key || '.py' AS file, early,
        lag(key) OVER (PARTITION BY repo ORDER BY key) AS before, max(key) OVER (PARTITION BY repo) AS last
    FROM (SELECT 'r' || o_custkey AS repo, o_orderkey AS key, o_orderdate < TIMESTAMP '1995-04-01' AS early FROM orders)""",
)
cte(
    "module_link",
    "module",
    """SELECT repo, file, repo || '/f' || before || '.py' AS target FROM module WHERE before IS NOT NULL
    UNION SELECT repo, file, repo || '/f' || last || '.py' FROM module WHERE key % 7 = 0""",
)
oracle("resolve_imports", "module_link", "SELECT repo, file, target FROM module_link")
for _name, _most in (("change_reach", 1000), ("change_reach_near", 2)):
    cte(
        _name,
        "module module_link",
        f"""SELECT repo, file, 0 AS distance FROM module WHERE early
        UNION SELECT l.repo, l.file, r.distance + 1 FROM {_name} r JOIN module_link l ON l.repo = r.repo AND l.target = r.file
        WHERE r.distance < least({_most}, (SELECT max(n) FROM (SELECT count(*) AS n FROM module GROUP BY repo)))""",
    )
    oracle(_name, _name, f"SELECT repo, file, min(distance)::INT AS distance FROM {_name} GROUP BY ALL")

oracle(
    "pr_events",
    "received",
    """SELECT event_id, CASE WHEN contains(full_name, '/') THEN split_part(full_name, '/', 1) ELSE '' END AS owner,
        CASE WHEN contains(full_name, '/') THEN substr(full_name, position('/' IN full_name) + 1) ELSE '' END AS repo,
        event_id AS pr_number, title, action
    FROM received WHERE kind = 'pull_request' AND action <> 'closed' AND complete""",
)
ORACLE["stream_pr_events"] = ORACLE["pr_events"]
ORACLE["stream_rules"] = ORACLE["run_rules_diffs"]
ORACLE["stream_rate_limit"] = ORACLE["rate_limit"]
ORACLE["stream_upsert_chunks"] = ORACLE["upsert_chunks"]
ORACLE["stream_acceptance"] = ORACLE["acceptance_rate"]
ORACLE["stream_usage_ledger"] = ORACLE["usage_ledger"]
_DAY = 86_400_000_000
oracle(
    "stream_rollup",
    "outcome",
    f"""SELECT us // {_DAY} * {_DAY} AS window_start, group_key, count(*) AS total_reviews, {_SUMS.format(over="")}
    FROM outcome GROUP BY 1, 2""",
)
