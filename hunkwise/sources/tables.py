"""Readers for raw diffs, labels and events, and the review store."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.model import columns_besides
from hunkwise.session import stored


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The same table as a file stream."""
    schema = read_table(spark, folder, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{name}[.]parquet")
    )


def write_side_files(rows: DataFrame, name: str, text: str, path: str, order: tuple[str, ...] = (), parts: int = 256) -> None:
    """One text file for each ``name``, at ``path``/part=../``name``=.., its lines in ``order``.

    Files lie in ``parts`` folders, which tasks list side by side, and each task puts its own
    in place. So the driver moves none; a write that breaks off may leave some, so the path must be a fresh one.
    In a mounted folder, tasks write with the system's own calls: a writer for any file system takes many
    times as long for a small file. Elsewhere a name is a folder with one file.
    """
    spark = rows.sparkSession
    by = [f"__{i}" for i in range(len(order))]
    dealt = rows.select(
        F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("part"),
        F.nullif(F.col(name).cast("string"), F.lit("")).alias("__name"),
        F.col(text).alias("__text"),
        *[F.col(o).alias(b) for o, b in zip(order, by)],
    )
    # An own number of tasks, as a file costs the same however short it is.
    tasks = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = dealt.repartition(tasks, "part", "__name").sortWithinPartitions("part", "__name", *by)
    folder = _mounted(path)
    if folder is None:
        sorted_rows.select("part", F.col("__name").alias(name), F.col("__text").alias("value")).write.partitionBy("part", name).option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2"
        ).text(path)
        return
    os.makedirs(folder, exist_ok=True)
    lines = sorted_rows.select("part", "__name", F.col("__text").cast("binary"))
    lines.mapInArrow(_put_files(folder, name), "files long").agg(F.sum("files")).collect()


#: Characters that a folder name shows as their code, as Spark's writer does.
_ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^") | {chr(i) for i in range(1, 32)}
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _put_files(folder: str, name: str):
    """A function that writes the lines of each (part, name), which follow each other, to a file of its own."""
    escaped, nothing = _ESCAPED, _NO_NAME

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        known, current, out, files = set(), None, None, 0

        def close() -> None:
            # Whole or not at all, also if a task runs twice.
            out.close()
            os.replace(out.name, f"{folder}/part={current[0]}/{name}={shown(current[1])}")

        def shown(value: str | None) -> str:
            return nothing if value is None else "".join(f"%{ord(c):02X}" if c in escaped else c for c in value)

        for batch in batches:
            for part, value, line in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if (part, value) != current:
                    if out is not None:
                        close()
                    current, files = (part, value), files + 1
                    if part not in known:
                        os.makedirs(f"{folder}/part={part}", exist_ok=True)
                        known.add(part)
                    out = open(f"{folder}/part={part}/.{attempt}.tmp", "wb")
                out.write((line or b"") + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return put


def _mounted(path: str) -> str | None:
    """The folder of a path on a file system that the system itself knows, if it is one."""
    plain = re.sub(r"^file:/+", "/", path)
    return plain if plain.startswith("/") else None


def _whole_files(spark: SparkSession, path: str, deep: bool) -> DataFrame:
    """(path, value): every file as a row. ``deep`` takes those of all folders below.

    Tasks list the folders of a mounted folder and read their files, so that neither the number of files nor their names
    burden the driver, and small files do not make a task of a few each.
    """
    folder = _mounted(path) if deep else None
    if folder is None or not os.path.isdir(folder):
        return spark.read.text(path, wholetext=True, recursiveFileLookup=deep).select(
            F.col("_metadata.file_path").alias("path"), "value"
        )
    found = sorted(e.path for e in os.scandir(folder))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def files(at: str) -> Iterator:
            name = os.path.basename(at)
            if name.startswith(".") or (name.startswith("_") and "=" not in name):
                return
            if os.path.isdir(at):
                for below in os.scandir(at):
                    yield from files(below.path)
            elif os.path.getsize(at):  # as for the reader, an empty file is no row
                yield at

        def batch_of(names: list, texts: list):
            shown = ["file:" + re.sub(_UNSAFE, lambda m: f"%{ord(m[0]):02X}", n) for n in names]
            return pa.RecordBatch.from_arrays([pa.array(shown, pa.string()), pa.array(texts, pa.binary())], names=["path", "value"])

        names, texts, size = [], [], 0
        for batch in batches:
            for top in batch.column("at").to_pylist():
                for file in files(top):
                    with pa.OSFile(file) if not file.endswith(_PACKED) else pa.input_stream(file) as f:
                        texts.append(f.read())
                    names.append(file)
                    size += len(texts[-1])
                    if size > BATCH_BYTES or len(names) == BATCH_FILES:
                        yield batch_of(names, texts)
                        names, texts, size = [], [], 0
        yield batch_of(names, texts)

    tops = spark.createDataFrame(list(enumerate(found)), "no long, at string")
    dealt = tops.repartitionByRange(max(1, min(len(found), MOST_TASKS)), "no").select("at")
    return dealt.mapInArrow(read, "path string, value binary").select("path", F.col("value").cast("string").alias("value"))


#: What is read at a time, tasks at most, and files that are read unpacked.
BATCH_BYTES, BATCH_FILES, MOST_TASKS = 4 << 20, 1_000, 1_024
_PACKED = (".gz", ".bz2")
#: Characters that a path shows as their code, as Spark's reader does.
_UNSAFE = r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f]"


def read_diffs(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """Diff files, one row each: (diff_id, raw). The path names the diff. ``deep`` takes those of all folders below."""
    return _whole_files(spark, path, deep).select(F.col("path").alias("diff_id"), F.col("value").alias("raw"))


LABEL_SCHEMA = "line long, category string, severity string, label string"


def read_labels(spark: SparkSession, path: str, name: Column | None = None, deep: bool = False) -> DataFrame:
    """Label side files, a JSON array per source file: one row per label. ``deep`` takes those of all folders below.

    ``file`` is the name of the source file, which the side file's name extends, or
    ``name``, a column over the side file's path ``label_path``.
    """
    base = F.substring_index(F.col("label_path"), "/", -1)
    named = F.concat(F.regexp_replace(base, r"\.expected\.json$", ""), F.lit(".py"))
    return (
        _whole_files(spark, path, deep)
        .select(F.col("path").alias("label_path"), "value")
        .select(
            (named if name is None else name).alias("file"),
            F.posexplode(F.from_json("value", f"array<struct<{_fields(LABEL_SCHEMA)}>>")).alias("label_seq", "l"),
        )
        .select("file", "label_seq", "l.*")
    )


def _fields(ddl: str) -> str:
    return ",".join(":".join(part.split()) for part in ddl.split(","))


# The event and actions that ask for a review.
REVIEW_EVENT = "pull_request"
REVIEW_ACTIONS = ("opened", "synchronize", "reopened")
PAYLOAD = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("pull_request", T.StructType([T.StructField("title", T.StringType())])),
        T.StructField("repository", T.StructType([T.StructField("full_name", T.StringType())])),
    ]
)


def pr_events(events: DataFrame, kind: str = "kind", body: str = "body") -> DataFrame:
    """Review requests among received events, batch or stream.

    Other kinds and actions are ignored, and so are payloads without an action, a
    number, a pull request and a repository. A repository name is split once.
    """
    p = F.col("p")
    full = F.coalesce(p["repository"]["full_name"], F.lit(""))
    cut = F.instr(full, "/")
    named = cut > 0
    return (
        events.where(F.col(kind) == REVIEW_EVENT)
        .withColumn("p", F.from_json(body, PAYLOAD))
        .where(
            p["action"].isin(*REVIEW_ACTIONS)
            & p["number"].isNotNull()
            & p["pull_request"].isNotNull()
            & p["repository"].isNotNull()
        )
        .select(
            *columns_besides(events, kind, body),
            F.when(named, F.substring_index(full, "/", 1)).otherwise("").alias("owner"),
            F.when(named, F.substring(full, cut + 1, F.length(full))).otherwise("").alias("repo"),
            p["number"].alias("pr_number"),
            F.coalesce(p["pull_request"]["title"], F.lit("")).alias("title"),
            p["action"].alias("action"),
        )
    )


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests that name an owner, a repository and a positive number; tokens are not kept."""
    ok = (F.length("owner") > 0) & (F.length("repo") > 0) & (F.col("pr_number") > 0)
    return requests.where(ok).select(*columns_besides(requests, "github_token"))


def review_uid(owner: Column, repo: Column, number: Column, created: Column) -> Column:
    """Twelve hex digits from what names a review, so that a rerun agrees."""
    text = F.concat(owner, F.lit("/"), repo, F.lit("#"), number.cast("string"), F.lit("@"), created.cast("string"))
    return F.substring(F.sha2(text, 256), 1, 12)


STORED = ("reviews", "findings", "files")
#: Tasks that each write all days may make so many files in all.
FEW_FILES = 10_000


def _versions(spark: SparkSession, path: str):
    """(file system, folder of version files, numbers of the versions)."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = fs_path(f"{path}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return fs, folder, sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    numbers = _versions(spark, path)[2]
    if not numbers:
        return {"version": 0, "folders": {n: [] for n in STORED}, "schemas": {}}
    number = numbers[-1] if version is None else version
    text = spark.read.text(f"{path}/versions/{number:08d}.json", wholetext=True).first()[0]
    return {"version": number, **json.loads(text)}


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Make the next version visible, all tables at once; fails if another writer was first."""
    fs, folder, _ = _versions(spark, path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(folder)
    own = fs_path(folder, f"{uuid.uuid4().hex}.tmp")
    out = fs.create(own)
    out.write(bytearray(json.dumps({k: manifest[k] for k in ("folders", "schemas")}).encode()))
    out.close()
    target = fs_path(folder, f"{manifest['version'] + 1:08d}.json")
    if fs.exists(target) or not fs.rename(own, target):
        fs.delete(own, False)
        raise RuntimeError(f"version {manifest['version'] + 1} of {path} was written meanwhile")


def write_reviews(reviews: DataFrame, findings: DataFrame, files: DataFrame, path: str) -> None:
    """Add reviews to a store of three flat tables, split by day of creation, in one commit.

    Findings and diffs stay rows of their own instead of lists inside a review, so
    listings never read them and no review can outgrow a row. Every write makes new folders; a small
    version file then names the folders of all tables, and readers follow the newest one, so
    a write that breaks off leaves nothing visible. A review that is stored is not stored again:
    ids are looked up once, in the days that are written, and a rerun adds nothing.
    """
    spark = reviews.sparkSession
    manifest = _manifest(spark, path)
    dated = reviews.select("*", F.to_date("created_at").alias("day"))
    first, last = dated.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return
    held = _table(spark, path, manifest, "reviews")
    if held is not None:
        dated = dated.join(held.where(F.col("day").between(first, last)).select("review_id").distinct(), "review_id", "left_anti")
    new = stored(dated, "new-reviews")
    if new.isEmpty():
        return
    days = new.select("review_id", "day")
    # Few files a day, however many tasks hold its rows. Where days are few, tasks write their own of each, as
    # bringing days together would shuffle all texts once more.
    files_of_tasks = new.select("day").distinct().count() * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = files.withColumnRenamed("diff_id", "review_id") if "diff_id" in files.columns else files
    name = f"c{uuid.uuid4().hex}"
    for table, df in (("findings", findings.join(days.hint("merge"), "review_id")), ("files", keyed.join(days.hint("merge"), "review_id")), ("reviews", new)):
        (df if files_of_tasks <= FEW_FILES else df.hint("rebalance", "day")).write.partitionBy("day").parquet(f"{path}/{table}/commit={name}")
        manifest["folders"][table].append(name)
        manifest["schemas"][table] = df.schema.json()
    _commit(spark, path, manifest)


def _table(spark: SparkSession, path: str, manifest: dict, table: str) -> DataFrame | None:
    folders = [f"{path}/{table}/commit={name}" for name in manifest["folders"][table]]
    if not folders:
        return None
    schema = T.StructType.fromJson(json.loads(manifest["schemas"][table]))
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(*folders).drop("commit")


def read_reviews(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The stored tables, typed: reviews, findings and files, all of the same version (default: the newest)."""
    manifest = _manifest(spark, path, version)
    found = {n: _table(spark, path, manifest, n) for n in STORED}
    if None in found.values():
        raise FileNotFoundError(f"no reviews are stored at {path}")
    return found


def page_of_reviews(reviews: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """The ``size`` newest reviews, or those that follow ``after``, the (created_at, review_id) of the last one seen.

    Newest first, ties by id. The cursor's day reaches the store as a filter on its folders, so a page
    far down does not read what was shown before it.
    """
    if after is not None:
        moment, last = F.lit(after[0]).cast(reviews.schema["created_at"].dataType), F.lit(after[1])
        older = (F.col("created_at") < moment) | ((F.col("created_at") == moment) & (F.col("review_id") > last))
        reviews = reviews.where(older)
        if "day" in reviews.columns:
            reviews = reviews.where(F.col("day") <= F.to_date(moment))
    return reviews.orderBy(F.desc("created_at"), "review_id").limit(size)


# Fixed value: a link of a page.
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'>]*)[\"']"


def page_links(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, link_no, target): the links of each page in order, as written."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))
    return pages.select(page_id, F.posexplode(links).alias("link_no", "target"))
