"""Unified diffs to files, hunks and numbered lines.

A diff is one row, so all ordering is inside a row: splitting and array functions
do the work, nothing is shuffled, and the same plan runs on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.text import strip, unify_breaks, with_lines, without_last_break
from hunkwise.model import READER_LINE_LIMIT, columns_besides

# The two header lines of a unified diff.
FILE_HEADER = r"(?md)^diff --git a/(.+?) b/(.+?)$"
HUNK_HEADER = (
    r"(?mdU)^@@[^\S\n]+-(\d+)(?:,(\d+))?[^\S\n]+\+(\d+)(?:,(\d+))?[^\S\n]+@@(.*)$"
)

# Once every line break is a newline these characters are free to mark places.
_FILE, _HUNK, _PART = "\r", "\x0b", "\x0c"


def _count(found: Column) -> Column:
    return F.when(found == "", F.lit(1).cast("long")).otherwise(found.try_cast("long"))


def _hunk(lines: Column, cap: int | None) -> Column:
    top = F.split(F.get(lines, 0), _PART)
    return F.transform(
        F.array(F.struct(top.alias("g"), F.slice(lines, 2, cap or 1 << 30).alias("lines"))),
        lambda h: F.struct(
            h["g"][0].try_cast("long").alias("old_start"),
            _count(h["g"][1]).alias("old_count"),
            h["g"][2].try_cast("long").alias("new_start"),
            _count(h["g"][3]).alias("new_count"),
            strip(h["g"][4]).alias("header"),
            h["lines"].alias("lines"),
        ),
    )[0]


def _file(parts: Column, cap: int | None) -> list[Column]:
    """The columns of a file from its header lines (first) and the lines of its hunks."""
    head = F.get(parts, 0)
    names = F.split(F.get(head, 0), _PART)
    old, new = F.get(names, 0), F.get(names, 1)
    header = F.concat_ws("\n", F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), new), F.slice(head, 2, 1 << 30))
    return [
        new.alias("filename"),
        F.nullif(old, new).alias("old_filename"),
        header.contains("new file mode").alias("is_new"),
        header.contains("deleted file mode").alias("is_deleted"),
        header.alias("raw_header"),
        F.transform(F.slice(parts, 2, 1 << 30), lambda h: _hunk(h, cap)).alias("hunks"),
    ]


def parse_files(diffs: DataFrame, cap: int | None = None, raw: str = "raw") -> DataFrame:
    """One row per file that has hunks; ``hunks`` nests them with their lines.

    Text before the first file header is dropped, a hunk without lines and a file
    without hunks vanish. With ``cap``, each hunk keeps its first ``cap`` lines only.

    Two pattern passes over the text mark the headers and cut them into their parts;
    all else is splitting at single characters.
    """
    keep = columns_besides(diffs, raw)
    marked = F.regexp_replace(
        F.regexp_replace(unify_breaks(F.col(raw)), HUNK_HEADER, _HUNK + _PART.join(f"${i}" for i in range(1, 6))),
        FILE_HEADER,
        f"{_FILE}$1{_PART}$2",
    )
    sections = F.slice(F.split(marked, _FILE), 2, 1 << 30)
    parts = F.transform(
        sections,
        lambda s: F.transform(F.split(s, _HUNK), lambda p: F.split(without_last_break(p), "\n")),
    )
    # the header comes first and always has its own line
    solid = F.transform(parts, lambda p: F.filter(p, lambda part, i: (i == 0) | (F.size(part) > 1)))
    # A file is a row before it is taken apart, so that a part which several columns need is made once.
    files = diffs.select(*keep, F.posexplode(F.filter(solid, lambda p: F.size(p) > 1)).alias("file_no", "__parts"))
    return files.select(*keep, "file_no", *_file(F.col("__parts"), cap))


def hunks_of(files: DataFrame) -> DataFrame:
    """One row per hunk."""
    keep = columns_besides(files, "hunks")
    # For a spread that drops empty lists, the planner tests the list beforehand, which would make all hunks twice.
    spread = files.select(*keep, F.posexplode_outer("hunks").alias("hunk_no", "h"))
    return spread.where(F.col("hunk_no").isNotNull()).select(*keep, "hunk_no", "h.*")


def parse_diff(diffs: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per diff line, with its file and hunk."""
    hunks = hunks_of(parse_files(diffs, cap).drop("raw_header"))
    keep = columns_besides(hunks, "lines")
    return hunks.select(*keep, F.posexplode("lines").alias("line_no", "line"))


def lines_as_added(files: DataFrame, source: str = "source") -> DataFrame:
    """Each file as one hunk in which every line is added, starting at line 1."""
    keep = columns_besides(files, source)
    lines = with_lines(files.where(F.octet_length(source) > 0), source, keep)
    return lines.select(
        *keep,
        F.lit(0).alias("hunk_no"),
        F.lit(0).cast("long").alias("old_start"),
        F.lit(0).cast("long").alias("old_count"),
        F.lit(1).cast("long").alias("new_start"),
        F.size("lines").cast("long").alias("new_count"),
        F.lit("").alias("header"),
        F.transform("lines", lambda l: F.concat(F.lit("+"), l)).alias("lines"),
    )


def is_added(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


NUMBER_BLOCK = 256


def line_blocks(hunks: DataFrame) -> DataFrame:
    """Hunks in rows of at most ``NUMBER_BLOCK`` lines: __block, __lines, __marks, and __old and __new,
    how many lines before the block have an old or a new number.

    ``__marks`` are the first characters of the lines, with a blank for those of context.
    """
    keep = columns_besides(hunks, "lines")
    size = NUMBER_BLOCK
    last = F.floor((F.size("lines") - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("lines", b * size + 1, F.lit(size)))
    mark = lambda l: F.when(l.startswith("-"), "-").when(l.startswith("+"), "+").otherwise(" ")
    marked = hunks.select(*keep, F.when(F.size("lines") > 0, cut).alias("__cut")).select(
        *keep, "__cut", F.transform("__cut", lambda c: F.array_join(F.transform(c, mark), "")).alias("__all")
    )

    def before(character: str) -> Column:
        """For each block, how many lines before it do not begin with ``character``."""
        sums = F.aggregate(
            "__all",
            F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("sum")),
            lambda acc, s: F.struct(
                F.array_append(acc["all"], acc["sum"]).alias("all"), (acc["sum"] + _bare(s, character)).alias("sum")
            ),
        )
        return F.when(F.size("__all") > 1, sums["all"]).otherwise(F.array(F.lit(0)))

    counted = marked.select(*keep, "__cut", "__all", before("+").alias("__olds"), before("-").alias("__news"))
    block = F.transform(
        "__cut",
        lambda c, b: F.struct(
            b.alias("__block"),
            c.alias("__lines"),
            F.get("__all", b).alias("__marks"),
            F.get("__olds", b).alias("__old"),
            F.get("__news", b).alias("__new"),
        ),
    )
    return counted.select(*keep, F.inline(block))


def _bare(marks: Column, character: str) -> Column:
    return F.length(F.replace(marks, F.lit(character), F.lit("")))


def numbered(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """The lines of blocks with ``keep``, line_no, line, old_line and new_line."""
    rows = blocks.select(*keep, "__block", "__marks", "__old", "__new", F.posexplode("__lines").alias("__at", "line"))
    inside = F.substring("__marks", F.lit(1), F.col("__at"))
    line = F.col("line")
    return rows.select(
        *keep,
        (F.col("__block") * NUMBER_BLOCK + F.col("__at")).alias("line_no"),
        "line",
        F.when(~line.startswith("+"), F.col("old_start") + F.col("__old") + _bare(inside, "+")).alias("old_line"),
        F.when(~line.startswith("-"), F.col("new_start") + F.col("__new") + _bare(inside, "-")).alias("new_line"),
    )


def number_lines(hunks: DataFrame) -> DataFrame:
    """One row per diff line with the line numbers a reader sees.

    The old number is null on ``+`` lines and the new one on ``-`` lines. A hunk is
    cut into blocks first; what stands before a block, and before a line in the first
    characters of its own, gives both counts. So a line of a long hunk costs no more than one of a
    short hunk, and no shuffle is needed.
    """
    return numbered(line_blocks(hunks), columns_besides(hunks, "lines"))


def added_lines(hunks: DataFrame) -> DataFrame:
    """Added lines with their new line number and without the marker.

    Every line but ``-`` lines moves the new number on by one, so the number is
    the position among those lines.
    """
    keep = columns_besides(hunks, "lines")
    kept = F.filter("lines", lambda l: ~l.startswith("-"))
    return (
        hunks.select(*keep, F.posexplode(kept).alias("__at", "line"))
        .where(is_added(F.col("line")))
        .select(
            *keep,
            (F.col("new_start") + F.col("__at")).alias("new_line"),
            F.expr("substring(line, 2)").alias("content"),
        )
    )


def reconstruct_source(files: DataFrame) -> DataFrame:
    """The text of each file after the change: added and context lines."""
    lines = F.filter(F.flatten(F.transform("hunks", lambda h: h["lines"])), lambda l: ~l.startswith("-"))
    bare = F.transform(
        lines,
        lambda l: F.when(is_added(l) | l.startswith(" "), F.substring(l, F.lit(2), F.length(l))).otherwise(l),
    )
    return files.select(*columns_besides(files, "hunks"), F.array_join(bare, "\n").alias("source"))


def format_diff(files: DataFrame, max_lines: int = READER_LINE_LIMIT) -> DataFrame:
    """Text of a file's hunks, up to the first hunk that starts after ``max_lines``.

    Hunks are never empty, so at most ``max_lines + 1`` of them can be kept.
    """
    keep = columns_besides(files, "hunks")
    shown = F.aggregate(
        F.slice("hunks", 1, max_lines + 2),
        F.struct(F.lit(0).alias("lines"), F.lit(0).alias("n")),
        lambda acc, h: F.when(acc["lines"] > max_lines, acc).otherwise(
            F.struct((acc["lines"] + F.size(h["lines"])).alias("lines"), (acc["n"] + 1).alias("n"))
        ),
    )["n"]
    counted = files.select(*keep, "hunks", shown.alias("__shown"))
    texts = F.transform(
        F.slice("hunks", F.lit(1), F.col("__shown")),
        lambda h: F.concat_ws(
            "\n",
            F.format_string(
                "@@ -%d,%d +%d,%d @@ %s",
                h["old_start"], h["old_count"], h["new_start"], h["new_count"], h["header"],
            ),
            h["lines"],
        ),
    )
    notice = F.when(
        F.col("__shown") < F.size("hunks"),
        F.array(F.format_string("[... %d hunks total, truncated ...]", F.size("hunks"))),
    ).otherwise(F.array().cast("array<string>"))
    return counted.select(*keep, F.array_join(F.concat(texts, notice), "\n").alias("text"))
