"""Import edges between files and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkwise.functions.text import unify_breaks
from hunkwise.model import columns_besides
from hunkwise.session import shared_dir, stored

# Where an import statement can begin, and its two forms. A parenthesised list may
# run over several lines.
_START = r"(?m)(?:^|;)[ \t]*"
_PLAIN = _START + r"import[ \t]+([^\n#;]+)"
_FROM = _START + r"(from[ \t]+\.*[ \t]*[\w.]*[ \t]+import[ \t]*(?:\([^)]*\)|[^\n#;]+))"
_DOTS = r"^from[ \t]+(\.*)"
_FROM_PARTS = r"(?s)^from[ \t]+\.*[ \t]*([\w.]*)[ \t]+import[ \t]*\(?([^)]*)\)?"
_ITEM = r"^([\w.*]+)(?:\s+as\s+(\w+))?$"


def import_edges(files: DataFrame, source: str = "source") -> DataFrame:
    """One row per imported name: module, name and alias; ``statement`` spells it out.

    Works on whole texts inside each row. For ``import m`` the name is null; leading
    dots of a relative import are not part of the module, ``level`` counts them.
    """
    keep = columns_besides(files, source)
    text = F.regexp_replace(unify_breaks(F.col(source)), r"\\\n", " ")
    plain = F.transform(
        F.regexp_extract_all(text, F.lit(_PLAIN), F.lit(1)),
        lambda s: F.struct(F.lit(None).cast("string").alias("module"), F.lit(0).alias("level"), s.alias("names")),
    )
    froms = F.transform(
        F.regexp_extract_all(text, F.lit(_FROM), F.lit(1)),
        lambda s: F.struct(
            F.regexp_extract(s, _FROM_PARTS, 1).alias("module"),
            F.length(F.regexp_extract(s, _DOTS, 1)).alias("level"),
            F.regexp_replace(F.regexp_extract(s, _FROM_PARTS, 2), r"#[^\n]*", "").alias("names"),
        ),
    )
    rows = (
        files.select(*keep, F.explode(F.concat(plain, froms)).alias("s"))
        .select(*keep, "s.module", "s.level", F.explode(F.split("s.names", ",")).alias("item"))
        .withColumn("item", F.regexp_replace("item", r"^\s+|\s+$", ""))
        .where(F.col("item").rlike(_ITEM))
        .withColumns(
            {
                "target": F.regexp_extract("item", _ITEM, 1),
                "alias": F.nullif(F.regexp_extract("item", _ITEM, 2), F.lit("")),
            }
        )
    )
    is_from = F.col("module").isNotNull()
    tail = F.when(F.col("alias").isNotNull(), F.concat(F.lit(" as "), "alias")).otherwise("")
    return rows.select(
        *keep,
        F.coalesce("module", "target").alias("module"),
        F.when(is_from, F.col("target")).alias("name"),
        "alias",
        "level",
        F.concat(
            F.when(is_from, F.concat(F.lit("from "), "module", F.lit(" import "))).otherwise("import "),
            "target",
            tail,
        ).alias("statement"),
    )


def dependents(edges: DataFrame, *keys: str) -> DataFrame:
    """How many files import a module: the reach of a change to it."""
    files = edges.select(*keys, "module", "file").distinct()
    return files.groupBy(*keys, "module").agg(F.count(F.lit(1)).alias("files"))


def _stem(file: Column) -> Column:
    """What a module path names: the file without its ending, the folder of a package."""
    return F.regexp_replace(file, r"(?:(?:^|/)__init__)?\.py$", "")


def resolve_imports(edges: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """Links between files: (keys, file, target), ``file`` importing from ``target``, each once.

    ``edges`` comes from ``import_edges``, ``files`` names all files. A module is a path below the
    root of its ``keys`` (a repository), or below the importer's folder, one up for every dot after
    the first. ``from m import n`` may mean module n of package m as well as a name in m; both
    are tried, and names that no file carries drop out. Files that end in no ``.py`` are no modules.
    """
    folders = F.split(F.col("file"), "/")
    inside = F.slice(folders, 1, F.greatest(F.size(folders) - F.col("level"), F.lit(0)))
    base = F.when(F.col("level") > 0, F.array_join(inside, "/")).otherwise("")
    module = F.replace(F.coalesce("module", F.lit("")), F.lit("."), F.lit("/"))

    def below(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")

    wanted = F.array_distinct(
        F.array_compact(F.array(below(base, module), F.when(F.col("name").isNotNull(), below(base, module, F.col("name")))))
    )
    asked = edges.select(*keys, "file", F.explode(wanted).alias("__stem")).distinct()
    known = files.where(F.col("file").endswith(".py")).select(
        *keys, F.col("file").alias("target"), _stem(F.col("file")).alias("__stem")
    )
    return asked.join(known.distinct(), [*keys, "__stem"]).select(*keys, "file", "target").distinct()


def change_reach(links: DataFrame, changed: DataFrame, *keys: str, depth: int | None = None) -> DataFrame:
    """(keys, file, distance): every file that a change reaches, by the fewest imports from a changed one.

    ``links`` comes from ``resolve_imports``. Changed files have distance 0; cycles end
    where no new file turns up; with ``depth`` farther files are left out. Each round joins only
    the files that the last one reached, and is a table of its own, so lineage stays short. A
    module that many files import is one row that meets all its importers, which skew joins split.
    """
    spark = links.sparkSession
    back = stored(
        links.select(*keys, F.col("target").alias("__from"), F.col("file").alias("__to")).where("__from <> __to").distinct(), "links"
    )
    base = shared_dir(spark, "reach")
    changed.select(*keys, "file").distinct().write.parquet(f"{base}/distance=0")
    done = 0
    while depth is None or done < depth:
        front = spark.read.parquet(f"{base}/distance={done}")
        hit = front.withColumnRenamed("file", "__from").join(back, [*keys, "__from"])
        reached = spark.read.parquet(base).select(*keys, "file")
        new = hit.select(*keys, F.col("__to").alias("file")).distinct().join(reached, [*keys, "file"], "left_anti")
        done += 1
        new.write.parquet(f"{base}/distance={done}")
        if spark.read.parquet(f"{base}/distance={done}").isEmpty():
            break
    return spark.read.parquet(base).select(*keys, "file", F.col("distance").cast("int"))
