import pytest
from pyspark.sql import functions as F

from hunkwise.functions.text import strip, truncate_utf8, with_lines
from hunkwise.operators import diff

RAW = """junk before
diff --git a/old.py b/new.py
similarity index 90%
--- a/old.py
+++ b/new.py
@@ -1,3 +1,4 @@ def f():
 context
-gone
+added
++ +odd
+++ looks like a header
\\ No newline at end of file
@@ -10 +20,0 @@
+tail
@@ -90,2 +91,2 @@ empty hunk
diff --git a/moved b/moved2
rename from moved
diff --git a/x.py b/x.py
new file mode 100644
@@ -0,0 +1 @@

diff --git "a/q u" "b/q u"
diff --git a/x.py b/x.py
deleted file mode 100644
@@ -1 +0,0 @@
-only
"""


def files(spark, raw=RAW, **kw):
    return diff.parse_files(spark.createDataFrame([(1, raw)], "diff_id long, raw string"), **kw)


def test_files(spark):
    rows = files(spark).orderBy("file_no").collect()
    assert [(r.file_no, r.filename, r.old_filename, r.is_new, r.is_deleted) for r in rows] == [
        (0, "new.py", "old.py", False, False),
        (1, "x.py", None, True, False),
        (2, "x.py", None, False, True),
    ]
    assert rows[0].raw_header.splitlines()[:2] == ["diff --git a/old.py b/new.py", "similarity index 90%"]
    first, second = rows[0].hunks
    assert (first.old_start, first.old_count, first.new_start, first.new_count, first.header) == (1, 3, 1, 4, "def f():")
    assert (second.old_count, second.new_count, second.lines) == (1, 0, ["+tail"])
    assert rows[1].hunks[0].lines == ["", 'diff --git "a/q u" "b/q u"']


@pytest.mark.parametrize("stop", ["\r\n", "\r", "\x0b", " ", "\x85"])
def test_other_line_breaks(spark, stop):
    raw = "diff --git a/a b/a\n@@ -1 +1 @@\n+one\n+two\n".replace("\n", stop)
    assert files(spark, raw).first().hunks[0].lines == ["+one", "+two"]


def test_hunk_cap_is_per_hunk(spark):
    raw = "diff --git a/a b/a\n" + "@@ -1 +1 @@\n+a\n+b\n+c\n" * 2
    assert [len(h.lines) for h in files(spark, raw, cap=2).first().hunks] == [2, 2]


def test_line_numbers(spark):
    rows = diff.number_lines(diff.hunks_of(files(spark))).where("file_no = 0 and hunk_no = 0").orderBy("line_no").collect()
    assert [(r.old_line, r.new_line) for r in rows] == [(1, 1), (2, None), (None, 2), (None, 3), (None, 4), (3, 5)]
    added = diff.added_lines(diff.hunks_of(files(spark))).where("file_no = 0").orderBy("hunk_no", "new_line").collect()
    assert [(r.new_line, r.content) for r in added] == [(2, "added"), (3, "+ +odd"), (20, "tail")]


def test_source_after_the_change(spark):
    text = diff.reconstruct_source(files(spark)).where("file_no = 0").first().source
    assert text.split("\n") == ["context", "added", "+ +odd", "+++ looks like a header", "\\ No newline at end of file", "tail"]


def test_reader_text_stops_at_a_hunk(spark):
    raw = "diff --git a/a b/a\n" + "".join(f"@@ -{i} +{i} @@ h\n+a\n+b\n" for i in range(1, 5))
    text = diff.format_diff(files(spark, raw), max_lines=3).first().text
    assert text == "@@ -1,1 +1,1 @@ h\n+a\n+b\n@@ -2,1 +2,1 @@ h\n+a\n+b\n[... 4 hunks total, truncated ...]"


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "a\n\n", "\n\na", "a\r\nb\rc\x0cd e", "a\x1d\x1eb"])
def test_lines_like_splitlines(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert with_lines(df, "t", [], "l").first().l == text.splitlines()


@pytest.mark.parametrize("text", [" x　", " \t\x1cx\x1f", "x", ""])
def test_strip(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(strip(F.col("t"))).first()[0] == text.strip()


@pytest.mark.parametrize("limit", range(1, 12))
def test_truncate_bytes(spark, limit):
    text = "aé€\U0001f600z"
    got = spark.createDataFrame([(text,)], "t string").select(truncate_utf8(F.col("t"), limit, "!")).first()[0]
    raw = text.encode()
    assert got == (raw[:limit].decode("utf-8", "replace") + "!" if len(raw) > limit else text)
