"""The named queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.functions import rules as R
from hunkwise.functions.text import strip, truncate_utf8
from hunkwise.operators import cases, chunks, diff, evaluate, findings, imports, ledger, scan, search
from hunkwise.plans.review import evaluate_rules, review_changes
from hunkwise.session import shared_dir, stored
from hunkwise.sources import samples as S
from hunkwise.sources import tables
from hunkwise.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LIMIT, LIMIT_WINDOW = 3, 86_400
BYTES = 1_000
TRUNCATED = "\n... [output truncated]"
TURN_TOKENS = 1_500
PAGE = 50
NEIGHBOURS = 10
FINDING = ["review_id", "file", "line_start", "line_end", "severity", "category", "explanation", "source"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def code_hunks(spark: SparkSession, d: str) -> DataFrame:
    return diff.lines_as_added(S.code_files(spark, d).withColumnRenamed("file", "filename"))


def document_hunks(spark: SparkSession, d: str) -> DataFrame:
    return diff.lines_as_added(S.documents(spark, d).withColumnRenamed("file", "filename"))


def diff_files(spark: SparkSession, d: str) -> DataFrame:
    return diff.parse_files(S.raw_diffs(spark, d))


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.merge_findings(
        scan.run_rules(code_hunks(spark, d)), scan.confidence_gate(S.code_submissions(spark, d))
    )


def ranked_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.rank_findings(findings.dedupe_findings(all_findings(spark, d)))


# --- diffs and lines ---


@query
def parse_diff(spark, d):
    return diff.parse_diff(S.raw_diffs(spark, d)).drop("repo").fillna({"old_filename": ""})


@query
def parse_diff_files(spark, d):
    return diff_files(spark, d).select(
        "diff_id",
        "file_no",
        "filename",
        F.coalesce("old_filename", F.lit("")).alias("old_filename"),
        "is_new",
        "is_deleted",
        "raw_header",
        F.size("hunks").alias("hunks"),
    )


@query
def lines_as_added(spark, d):
    return (
        document_hunks(spark, d)
        .select("diff_id", "filename", "new_count", F.posexplode("lines").alias("line_no", "line"))
    )


@query
def number_lines(spark, d):
    numbered = diff.number_lines(diff.hunks_of(diff_files(spark, d)))
    none = F.lit(-1).cast("long")
    return numbered.select(
        "diff_id",
        "file_no",
        "hunk_no",
        "line_no",
        F.coalesce("old_line", none).alias("old_line"),
        F.coalesce("new_line", none).alias("new_line"),
    )


@query
def added_lines(spark, d):
    added = diff.added_lines(diff.hunks_of(diff_files(spark, d)))
    return added.select("diff_id", "file_no", "filename", "hunk_no", "new_line", "content")


@query
def reconstruct_source(spark, d):
    return diff.reconstruct_source(diff_files(spark, d)).select("diff_id", "file_no", "filename", "source")


@query
def format_diff(spark, d):
    return diff.format_diff(diff_files(spark, d), max_lines=12).select("diff_id", "file_no", "filename", "text")


@query
def truncate_bytes(spark, d):
    docs = tables.read_table(spark, d, "documents")
    return docs.select("doc_id", truncate_utf8(F.col("text"), BYTES, TRUNCATED).alias("text"))


# --- scans and screens ---


@query
def scan_sql_injection(spark, d):
    return scan.scan_sql_injection(code_hunks(spark, d)).select(*FINDING)


@query
def scan_exceptions(spark, d):
    return scan.scan_exceptions(code_hunks(spark, d)).select(*FINDING)


@query
def scan_secrets(spark, d):
    return scan.scan_secrets(document_hunks(spark, d)).select(*FINDING)


@query
def run_rules(spark, d):
    return scan.run_rules(code_hunks(spark, d)).select(*FINDING, "suggested_fix")


@query
def run_rules_diffs(spark, d):
    hunks = diff.hunks_of(diff_files(spark, d))
    return scan.run_rules(hunks).select("file_no", *FINDING)


@query
def blocklist_screen(spark, d):
    return scan.blocklist_screen(S.code_files(spark, d), "source").select("diff_id", "file", "blocked_by")


@query
def screen_injection(spark, d):
    return scan.screen_injection(S.screen_texts(spark, d), "text").select("conv_id", "turn", "hits", "clean")


@query
def redact_plain(spark, d):
    docs = tables.read_table(spark, d, "documents").select("doc_id", "text")
    return scan.redact(docs, ["text"], R.REDACT_PLAIN)


@query
def redact_typed(spark, d):
    docs = tables.read_table(spark, d, "documents").select("doc_id", "text")
    return scan.redact(docs, ["text"], R.REDACT_TYPED)


@query
def confidence_gate(spark, d):
    kept = scan.confidence_gate(S.code_submissions(spark, d))
    return kept.select(*FINDING, "suggested_fix", "confidence", "reasoning_trace")


# --- findings ---


@query
def merge_findings(spark, d):
    return all_findings(spark, d).select(*FINDING, "confidence")


@query
def dedupe_findings(spark, d):
    return findings.dedupe_findings(all_findings(spark, d)).select(*FINDING, "confidence")


@query
def rank_findings(spark, d):
    return ranked_findings(spark, d).select(*FINDING, "rank")


@query
def attach_findings(spark, d):
    hunks = diff.hunks_of(diff_files(spark, d))
    found = findings.dedupe_findings(scan.run_rules(hunks))
    none = F.lit(-1).cast("long")
    return findings.attach_findings(hunks, found).select(
        "diff_id",
        "file_no",
        "hunk_no",
        "line_no",
        F.coalesce("new_line", none).alias("new_line"),
        F.coalesce("severity", F.lit("")).alias("severity"),
        F.coalesce("category", F.lit("")).alias("category"),
    )


@query
def severity_rollup(spark, d):
    files, found = review_changes(S.raw_diffs(spark, d), S.code_submissions(spark, d))
    rolled = findings.severity_rollup(S.reviews(spark, d), found, files)
    return rolled.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd")).withColumn(
        "uid", tables.review_uid(F.col("owner"), F.col("repo"), F.col("pr_number"), F.col("created_at"))
    )


@query
def review_detail(spark, d):
    detail = findings.review_detail(S.reviews(spark, d), ranked_findings(spark, d))
    return detail.select(
        "review_id",
        "owner",
        "repo",
        "pr_title",
        F.coalesce("rank", F.lit(0)).cast("long").alias("rank"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("file", "severity", "category", "explanation", "source")],
        F.coalesce("line_start", F.lit(0)).alias("line_start"),
    )


def yearly_reviews(spark, d):
    """Reviews as if created on the first day of their year, so that the store has days of many reviews."""
    return S.reviews(spark, d).withColumn("created_at", F.date_trunc("year", "created_at").cast("timestamp_ntz"))


@query
def stored_reviews(spark, d):
    """Reviews written to a store twice and read back, with what is stored of each."""
    files, found = review_changes(S.raw_diffs(spark, d))
    path = shared_dir(spark, "store")
    for _ in range(2):
        tables.write_reviews(yearly_reviews(spark, d), found, files, path)
    store = tables.read_reviews(spark, path)

    def count(name: str):
        return store[name].groupBy("review_id").agg(F.count(F.lit(1)).alias(name))

    listed = store["reviews"].join(count("files"), "review_id", "left").join(count("findings"), "review_id", "left")
    return listed.select(
        "review_id",
        "owner",
        "repo",
        "pr_number",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("files", "findings")],
    )


@query
def stored_detail(spark, d):
    """The diffs of stored reviews, each looked up by its id."""
    files, found = review_changes(S.raw_diffs(spark, d))
    path = shared_dir(spark, "store")
    tables.write_reviews(yearly_reviews(spark, d), found, files, path)
    store = tables.read_reviews(spark, path)
    # Hunks are counted where they are read, by a field that is short, so that no text of theirs is joined.
    files = store["files"].select("review_id", "file_no", "filename", F.size("hunks.old_start").alias("hunks"), "raw_header")
    return store["reviews"].select("review_id", "pr_title").join(files, "review_id").select(
        "review_id", "pr_title", "file_no", "filename", "hunks", "raw_header"
    )


@query
def read_diffs(spark, d):
    """A diff file of each repository, written below the shared folder and read back by its path."""
    path = shared_dir(spark, "diffs")
    rows = S.raw_diffs(spark, d).withColumn("raw", F.regexp_replace("raw", "\n$", ""))
    tables.write_side_files(rows, "repo", "raw", path, ("diff_id",))
    back = diff.parse_files(tables.read_diffs(spark, path, deep=True))
    return back.groupBy(F.regexp_extract("diff_id", r"/repo=(\w+)", 1).alias("repo")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.size("hunks")).alias("hunks"), F.max("file_no").alias("last_file_no")
    )


@query
def stored_page(spark, d):
    """The second page of fifty stored reviews, newest first, from where the first one ended."""
    files, found = review_changes(S.raw_diffs(spark, d))
    path = shared_dir(spark, "store")
    tables.write_reviews(yearly_reviews(spark, d), found, files, path)
    listed = tables.read_reviews(spark, path)["reviews"]
    seen = tables.page_of_reviews(listed, PAGE).collect()
    after = (seen[-1]["created_at"], seen[-1]["review_id"]) if seen else None
    page = tables.page_of_reviews(listed, PAGE, after)
    return page.select("review_id", "owner", "repo", "pr_number", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query
def read_labels(spark, d):
    """The labels of each repository as a side file, written below the shared folder and read back by its path."""
    path = shared_dir(spark, "labels")
    label = F.struct("review_id", "label_seq", "line", "category", "severity", "label")
    rows = S.code_labels(spark, d).groupBy(F.split_part("file", F.lit("/"), F.lit(1)).alias("repo")).agg(
        F.to_json(F.sort_array(F.collect_list(label))).alias("value")
    )
    tables.write_side_files(rows, "repo", "value", path)
    repo = F.regexp_extract("label_path", r"/repo=(\w+)", 1)
    return tables.read_labels(spark, path, repo, deep=True).withColumnRenamed("file", "repo")


@query
def page_links(spark, d):
    return tables.page_links(tables.read_table(spark, d, "pages"))


@query
def file_badges(spark, d):
    files, found = review_changes(S.raw_diffs(spark, d))
    return findings.file_badges(files, found).select(
        "diff_id", "file_no", "filename", "base_name", "findings", F.coalesce("highest", F.lit("")).alias("highest")
    )


@query
def report_comments(spark, d):
    found = findings.dedupe_findings(all_findings(spark, d))
    return findings.report_comments(found).select(
        "review_id", "path", "line", F.coalesce("start_line", F.lit(0)).alias("start_line"), "body"
    )


@query
def report_payload(spark, d):
    return findings.report_payload(ranked_findings(spark, d))


@query
def review_json_roundtrip(spark, d):
    again = findings.findings_from_json(findings.findings_to_json(all_findings(spark, d)))
    return again.select(*FINDING, "suggested_fix", "confidence", "reasoning_trace")


# --- evaluation ---


@query
def match_labels(spark, d):
    found = scan.run_rules(code_hunks(spark, d))
    pairs = evaluate.match_labels(found, S.code_labels(spark, d))
    none = F.lit(-1).cast("long")
    return pairs.select(
        "review_id",
        "file",
        "category",
        "outcome",
        *[F.coalesce(c, none).alias(c) for c in ("finding_line", "label_seq", "label_line")],
    )


@query
def eval_metrics(spark, d):
    return evaluate_rules(S.code_files(spark, d), S.code_labels(spark, d))


@query
def eval_total(spark, d):
    return evaluate.eval_total(evaluate_rules(S.code_files(spark, d), S.code_labels(spark, d)))


@query
def eval_levels(spark, d):
    """Scores of files, repositories and all from one aggregation."""
    files = S.code_files(spark, d)
    pairs = evaluate.match_labels(scan.run_rules(code_hunks(spark, d)), S.code_labels(spark, d))
    owner = F.split_part("file", F.lit("/"), F.lit(1)).alias("repo")
    levels = evaluate.eval_levels(pairs.select(owner, "file", "outcome"), files)
    return levels.withColumns({c: F.coalesce(c, F.lit("")) for c in ("repo", "file")})


@query
def label_eval(spark, d):
    """Labelled documents: a secret found in one against its being marked as toxic."""
    labels = tables.read_table(spark, d, "labels").select(F.col("doc_id").alias("review_id"), "toxic")
    # A document is flagged or not, wherever in it the secret stands.
    hunks = document_hunks(spark, d).join(labels.select(F.col("review_id").alias("diff_id")), "diff_id", "left_semi")
    found = scan.scan_secrets(hunks).groupBy("review_id", "category").agg(
        F.min("finding_seq").alias("finding_seq"), F.lit(1).cast("long").alias("line_start")
    )
    expected = labels.where("toxic = 1").select(
        "review_id", F.lit("security").alias("category"), F.lit(0).alias("label_seq"), F.lit(1).alias("line")
    )
    outcomes = evaluate.match_labels(found, expected, ["review_id"])
    return evaluate.eval_metrics(outcomes, labels.select("review_id"), ["review_id"])


@query
def acceptance_rate(spark, d):
    tracked = evaluate.last_resolutions(S.posted(spark, d), S.resolutions(spark, d))
    return evaluate.acceptance_rate(
        tracked.withColumn("review", F.substring_index("finding_id", "-", 1).cast("long")), "review"
    )


# --- limits and budgets ---


@query
def rate_limit(spark, d):
    limited = ledger.rate_limit(S.events(spark, d), "user_id", "at", "event_id", LIMIT, LIMIT_WINDOW)
    return limited.select("event_id", "user_id", "at", "allowed")


@query
def quota_remaining(spark, d):
    events = S.events(spark, d)
    accepted = ledger.rate_limit(events, "user_id", "at", "event_id", LIMIT, LIMIT_WINDOW).where("allowed")
    probes = events.select(F.col("event_id").alias("probe_id"), "user_id", "at")
    return ledger.quota_remaining(accepted, probes, "user_id", "at", LIMIT, LIMIT_WINDOW).select(
        "probe_id", "user_id", F.col("remaining").cast("long").alias("remaining")
    )


@query
def usage_ledger(spark, d):
    return ledger.usage_ledger(S.usage(spark, d)).select(
        "review_id", "seq", "epoch", "total_tokens", "api_calls", "cost_usd", "within_cap"
    )


@query
def usage_totals(spark, d):
    return ledger.usage_totals(ledger.usage_ledger(S.usage(spark, d)))


@query
def empty_rate_monitor(spark, d):
    return ledger.empty_rate_monitor(S.outcomes(spark, d)).select(
        "group_key", "seq", "total_reviews", "empty_reviews", "agent_failures", "rule_only_reviews", "alarm"
    )


@query
def outcome_counts(spark, d):
    return ledger.outcome_counts(S.outcomes(spark, d))


@query
def turn_budget(spark, d):
    return ledger.turn_budget(S.model_calls(spark, d), budget=TURN_TOKENS).select(
        "conv_id", "turn", "tokens_before", "calls_before", "kept", "gives_findings"
    )


# --- chunks and search ---


@query
def chunk_lines(spark, d):
    return chunks.chunk_lines(S.documents(spark, d)).select(
        "diff_id", "chunk_no", "type", "line_start", "line_end", "content"
    )


@query
def chunk_blocks(spark, d):
    return (
        chunks.chunk_blocks(S.code_files(spark, d))
        .fillna({"name": ""})
        .select("diff_id", "file", "chunk_no", "type", "name", "line_start", "line_end", "content")
    )


@query
def chunk_keys(spark, d):
    keyed = chunks.chunk_keys(chunks.chunk_lines(S.documents(spark, d)))
    return keyed.select("diff_id", "chunk_no", "chunk_id")


def code_chunks(spark, d, stream=False):
    """Code chunks by arrival; many repositories hold a setup.py."""
    name = F.when(F.col("diff_id") % 3 == 0, "setup.py").otherwise(F.col("file"))
    made = chunks.chunk_blocks(S.code_files(spark, d, stream)).withColumn("file", name)
    return made.withColumnRenamed("diff_id", "arrival")


LOADED = ["repo", "chunk_id", "file", "line_start", "content", "arrival", "batch_no"]


def loaded(made, batch_no):
    """Chunks as a load brings them, with their keys: in the second load some are changed."""
    changed = F.when((batch_no == 2) & (F.col("arrival") % 2 == 0), F.concat("content", F.lit(" #")))
    there = made.where(strip(F.col("content")) != "")
    load = there.select(
        "repo", "file", "line_start", F.coalesce(changed, F.col("content")).alias("content"), "arrival", batch_no.alias("batch_no")
    )
    return chunks.chunk_keys(load).select(*LOADED)


@query
def upsert_chunks(spark, d):
    made = code_chunks(spark, d)
    both = [loaded(made, F.lit(n)) for n in (1, 2)]
    return chunks.upsert_chunks(*both).select("repo", "chunk_id", "file", "line_start", "batch_no")


@query
def stream_upsert_chunks(spark, d):
    """Both loads as a stream, merged into a table batch by batch. A file is read and cut once for both."""
    made = code_chunks(spark, d, stream=True)
    twice = made.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("load"))
    path = shared_dir(spark, "chunks")
    streams.drain_into(loaded(twice, F.col("load")), "upsert", streams.stream_upsert(path, ("repo", "chunk_id")))
    return spark.read.parquet(path).select("repo", "chunk_id", "file", "line_start", "batch_no")


@query
def history_docs(spark, d):
    docs = chunks.history_docs(findings.dedupe_findings(all_findings(spark, d)))
    return docs.select("review_id", "content", "file", "type", "line_start", "line_end")


@query
def tfidf_top_terms(spark, d):
    docs = tables.read_table(spark, d, "documents").select("doc_id", "text")
    return search.top_terms(search.term_weights(docs, "doc_id", "text"), "doc_id").select(
        "doc_id", "rank", "term", "weight"
    )


@query
def top_k_similar(spark, d):
    vectors = tables.read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search.top_k_similar(
        vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "chunk_id")
    )


def vector_sides(spark, d):
    """Vectors whose id is divisible by 100 as queries, and all vectors."""
    vectors = tables.read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return asked, vectors.withColumnRenamed("vec_id", "chunk_id")


@query
def exact_neighbours(spark, d):
    return search.top_k_similar(*vector_sides(spark, d), NEIGHBOURS)


@query
def approximate_neighbours(spark, d):
    """The same by cells; every vector is in one, and scores are exact."""
    asked, held = vector_sides(spark, d)
    return search.approximate_top_k(asked, held, search.fit_cells(held), NEIGHBOURS)


@query
def text_search(spark, d):
    parts = chunks.chunk_keys(chunks.chunk_lines(S.documents(spark, d)))
    items = tables.read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    idf = search.bucket_idf(parts, "content")
    return search.top_k_similar(
        search.vectorize_text(items, "text", idf), search.vectorize_text(parts, "content", idf)
    )


def code_context(spark, d):
    """Context of every changed file from the chunks of its repository's code files."""
    made = chunks.chunk_keys(chunks.chunk_blocks(S.code_files(spark, d))).select("repo", "chunk_id", "file", "content")
    texts = search.query_texts(diff_files(spark, d)).select(
        F.concat_ws(":", F.col("diff_id").cast("string"), F.col("file_no").cast("string")).alias("query_id"),
        "repo",
        F.col("filename").alias("file"),
        "query",
    )
    # Files are cut, diffs parsed and words looked up once; weights, sizes of groups and the search read what that gave.
    parts = stored(search.vectorize_text(made, "content"), "chunks")
    asked = stored(search.vectorize_text(texts, "query").drop("query"), "questions")
    context = search.retrieve_context(asked, parts, by=["repo"], weights=search.bucket_idf(parts, "vector"))
    return context.select(
        F.substring_index("query_id", ":", 1).cast("long").alias("diff_id"),
        F.substring_index("query_id", ":", -1).cast("int").alias("file_no"),
        "context",
    )


@query
def retrieve_context(spark, d):
    return code_context(spark, d)


@query
def assemble_case(spark, d):
    files = diff_files(spark, d)
    return cases.assemble_case(files, code_context(spark, d), scan.run_rules(diff.hunks_of(files)))


@query
def import_edges(spark, d):
    edges = imports.import_edges(S.code_files(spark, d))
    return edges.select("diff_id", "file", "module", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "alias")], "statement")


@query
def dependents(spark, d):
    return imports.dependents(imports.import_edges(S.code_files(spark, d)), "repo")


def change_links(spark, d):
    files = S.linked_files(spark, d)
    edges = imports.import_edges(files.drop("changed"))
    return files, imports.resolve_imports(edges, files, "repo")


@query
def resolve_imports(spark, d):
    return change_links(spark, d)[1]


@query
def change_reach(spark, d):
    """Every module that a change of the early ones reaches, however far."""
    files, links = change_links(spark, d)
    return imports.change_reach(links, files.where("changed"), "repo")


@query
def change_reach_near(spark, d):
    files, links = change_links(spark, d)
    return imports.change_reach(links, files.where("changed"), "repo", depth=2)


# --- events and streams ---


@query
def pr_events(spark, d):
    return tables.pr_events(S.received_events(spark, d))


@query
def stream_pr_events(spark, d):
    return streams.drain(streams.stream_pr_events(S.received_events(spark, d, stream=True)), "pr-events")


@query
def stream_rules(spark, d):
    found = streams.stream_rules(S.raw_diffs(spark, d, stream=True))
    return streams.drain(found.select("file_no", *FINDING), "rules")


@query
def stream_rate_limit(spark, d):
    events = S.events(spark, d, stream=True)
    limited = streams.stream_rate_limit(events, "user_id", "at", "event_id", LIMIT, LIMIT_WINDOW)
    return streams.drain_updates(limited, "rate-limit", ["event_id"]).select("event_id", "user_id", "at", "allowed")


@query
def stream_rollup(spark, d):
    """Counts of all windows, however late a row comes."""
    outcomes = S.outcomes(spark, d, stream=True)
    return streams.drain_sums(outcomes, "rollup", streams.roll_up, ["window_start", "group_key"])


@query
def stream_acceptance(spark, d):
    """Posted findings and resolutions as two streams; the horizon covers the table, as no posting is ever withdrawn."""
    first, last = S.span_of(spark, d)
    horizon = (last - first) // 1_000_000 + 1
    posted, solved = S.posted(spark, d, stream=True), S.resolutions(spark, d, stream=True)
    ends = [streams.Closing(spark, x, "closing") for x in (posted, solved)]

    def close() -> None:
        beyond = last + (2 * horizon + 60) * 1_000_000  # past the delay and the horizon of the last row
        ends[0].add(posted_at=beyond)
        ends[1].add(ts=beyond, finding_id="")

    pairs = streams.stream_acceptance(
        posted.unionByName(ends[0].stream), solved.unionByName(ends[1].stream), f"{horizon} seconds", f"{horizon} seconds"
    )
    tracked = streams.last_of_posted(streams.drain(pairs, "acceptance", close).where("finding_id is not null"))
    return evaluate.acceptance_rate(
        tracked.withColumn("review", F.substring_index("finding_id", "-", 1).cast("long")), "review"
    )


@query
def stream_usage_ledger(spark, d):
    """The ledger with state by review; the delay covers the table, which is in no order."""
    first, last = S.span_of(spark, d)
    span = (last - first) // 1_000_000 + 1
    usage = S.usage(spark, d, stream=True)
    end = streams.Closing(spark, usage, "closing")

    def close() -> None:
        end.add(at=last + (2 * span + 60) * 1_000_000, seq=0, kind="start", tokens=0)

    with streams.rocks_state(spark):
        ledger = streams.stream_usage(usage.unionByName(end.stream), f"{span} seconds")
        rows = streams.drain(ledger, "usage", close).where("review_id is not null")
    return rows.select("review_id", "seq", "epoch", "total_tokens", "api_calls", "cost_usd", "within_cap")
