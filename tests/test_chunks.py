from hunkwise.operators import chunks, imports

SOURCE = '''"""Doc."""
import os

@first
def one(
    a,
):
    return a


@second
async def two():
    pass
    # trailing

class Three:
    x = 1

if True:
    y = 2
'''


def files(spark, *rows):
    return spark.createDataFrame(rows, "file string, source string")


def test_blocks(spark):
    rows = chunks.chunk_blocks(files(spark, ("a.py", SOURCE))).orderBy("chunk_no").collect()
    assert [(r.type, r.name, r.line_start, r.line_end) for r in rows] == [
        ("module_header", None, 1, 4),
        ("FunctionDef", "one", 5, 8),
        ("AsyncFunctionDef", "two", 12, 13),
        ("ClassDef", "Three", 16, 17),
    ]
    assert rows[0].content == '"""Doc."""\nimport os\n\n@first'
    assert rows[3].content == "class Three:\n    x = 1"


def test_windows(spark):
    text = "\n".join(map(str, range(101)))
    rows = chunks.chunk_blocks(files(spark, ("a.txt", text), ("e.py", ""))).orderBy("chunk_no").collect()
    assert [(r.line_start, r.line_end) for r in rows] == [(1, 50), (51, 100), (101, 101)]
    assert rows[2].content == "100"


def test_upsert_keeps_the_latest(spark):
    made = chunks.chunk_keys(chunks.chunk_lines(files(spark, ("a", "x"), ("b", " \n"))))
    assert made.count() == 1
    row = made.select("chunk_id", "content")
    old = row.selectExpr("*", "1 AS batch_no", "1 AS arrival")
    new = row.selectExpr("*", "2 AS batch_no", "0 AS arrival")
    assert chunks.upsert_chunks(old, new).first().batch_no == 2


def test_imports(spark):
    text = (
        "import os, sys as s\nfrom a.b import (\n    c,  # note\n    d as e,\n)\nfrom . import f\nfrom ..g import *\n"
        "x = 1; import h\n    import late\nimportant = 1\nfrom z import \\\n    y\n"
    )
    got = [r.statement for r in imports.import_edges(files(spark, ("a.py", text))).collect()]
    assert sorted(got) == sorted(
        ["import os", "import sys as s", "from a.b import c", "from a.b import d as e", "from  import f",
         "from g import *", "import h", "import late", "from z import y"]
    )
