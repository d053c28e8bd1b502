"""Project files and conversation files as DataFrames, with ignore rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of a project, and what is passed over.
EXTENSIONS = ".txt .md .py .js .ts .jsx .tsx .json .yaml .yml .html .css .java .go .rs .rb .sh .csv .sql .toml".split()
SKIP_FOLDERS = ".git node_modules __pycache__ .venv venv env dist build .next coverage".split()
CONVERSATIONS = ".txt .md .json .jsonl".split()
MOST_BYTES = 10 << 20


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression on the path below its folder, whether it ignores)."""
    line = line.rstrip("\n").rstrip(" ") if not line.endswith("\\ ") else line
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    line = line.removeprefix("!").removeprefix("\\")
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), ignores


def ignored(path: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Whether ignore files leave a path out. rules: (folder of the file, '' for the top; its lines), outer folders first.

    Of all rules that match, the last one decides.
    """
    out = F.lit(False)
    for folder, lines in rules:
        below = path if not folder else F.when(path.startswith(folder + "/"), F.substr(path, F.lit(len(folder) + 2)))
        for line in lines:
            if rule := ignore_rule(line):
                out = F.when(below.rlike(rule[0]), F.lit(rule[1])).otherwise(out)
    return out


def forced(path: Column, wanted: Sequence[str]) -> Column:
    """Paths to take whatever the ignore rules say: the wanted ones, and what lies below them."""
    out = F.lit(False)
    for w in wanted:
        out = out | (path == w) | path.startswith(w.rstrip("/") + "/")
    return out


def scan_project(spark: SparkSession, root: str, rules: Sequence[tuple[str, Sequence[str]]] = (), include: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """path (below root), mtime, size, document (UTF-8, malformed bytes replaced) of a project's files.

    Contents are read for the files that pass only: the filter on names and sizes stands below the decoding.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*" + re.escape(top.lstrip("/")) + "/", "")
    rows = files.withColumn("path", path).where(F.col("length") <= MOST_BYTES)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = _any([name.endswith(e) for e in extensions])
    hidden = F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, SKIP_FOLDERS)))
    passed = kind & ~hidden & ~ignored(F.col("path"), rules)
    return rows.where(passed | forced(F.col("path"), include)).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("document"))


def scan_conversations(spark: SparkSession, root: str) -> DataFrame:
    """path, document of conversation files; sidecars (.meta.json) are none."""
    return scan_project(spark, root, extensions=CONVERSATIONS).where(~F.lower("path").endswith(".meta.json")).select("path", "document")


def scan_diary(spark: SparkSession, root: str, least: int = 50) -> DataFrame:
    """path, day, entry, text: the ## entries of YYYY-MM-DD*.md files of `least` characters or more."""
    files = scan_project(spark, root, extensions=(".md",)).where(F.regexp_like("path", F.lit(r"(?:^|/)\d{4}-\d{2}-\d{2}[^/]*\.md$")) & (F.char_length("document") >= least))
    entries = F.filter(F.split("document", r"(?m)^(?=## )"), lambda e: e.startswith("## "))
    return files.select("path", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1).alias("day"), F.posexplode(entries).alias("entry", "text"))


def guess_rooms(paths: DataFrame, folders: dict[str, str], least: int = 2, n: int = 6) -> DataFrame:
    """room, files: rooms by folder names of the first two levels, else by first parts of file names that several files share."""
    parts = F.split(F.lower("path"), "/")
    known = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    upper = F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1))
    room = F.try_element_at(F.array_compact(F.transform(upper, lambda p: F.try_element_at(known, p))), F.lit(1))
    first = F.regexp_extract(F.element_at(parts, -1), r"^([a-z]+)", 1)
    found = paths.withColumn("room", F.coalesce(room, F.nullif(first, F.lit("")))).where("room is not null")
    return found.groupBy("room").agg(F.count("*").alias("files")).where(F.col("files") >= least).orderBy(F.desc("files"), "room").limit(n)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
