"""Reading and writing manuscript projects.

A project is a folder with ``paper/paper.yaml``, ``paper/sections/*.md`` and, once worked
on, ``frame/``.  Section files are read as bytes (the ``text`` source would lose final line
feeds and carriage returns); many projects are read in one job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.schemas import OUTLINES, RULES, TERMS


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    fs, target = _fs(spark, path)
    return fs.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    row = spark.read.format("binaryFile").load(path).select(F.decode("content", "utf-8")).first()
    return row[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file under its own name: written aside, then put in the old one's place in one step."""
    fs, target = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    spare = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(spare, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(spare), fs.makeQualified(target), over)


def parse_manifest(text: str) -> tuple[str, list[str]]:
    """Title and section order of the two-key YAML subset that manifests use."""
    title, sections, inside = "", [], False
    for line in text.splitlines():
        plain = line.strip()
        if not line.startswith((" ", "-", "\t")) and ":" in line:
            key, _, value = plain.partition(":")
            inside = key == "sections"
            if key == "title":
                title = value.strip().strip("\"'")
            elif inside and value.strip().startswith("["):
                sections += [x.strip().strip("\"'") for x in value.strip().strip("[]").split(",") if x.strip()]
        elif inside and plain.startswith("-"):
            sections.append(plain[1:].strip().strip("\"'"))
    return title, sections


def _listed(spark: SparkSession, path: str, project: Column) -> DataFrame:
    """project, file, at: the order that each manifest at ``path`` (a file or a pattern) gives."""
    held = spark.read.format("binaryFile").load(path).select(project.alias("project"), F.decode("content", "utf-8").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = [parse_manifest(text)[1] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("project"), pa.array(lists, pa.list_(pa.string()))], ["project", "files"])

    files = held.mapInArrow(run, "project string, files array<string>").select("project", F.posexplode("files").alias("at", "file"))
    return files.groupBy("project", "file").agg(F.min("at").alias("at"))


def _in_order(spark: SparkSession, folder: str, manifest: str | None, project: Callable[[str], Column]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select(project(folder).alias("project"), F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "utf-8").alias("text"))
    none = spark.createDataFrame([], "project string, file string, at int")
    listed = _listed(spark, manifest, project(manifest)) if manifest else none
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.coalesce("at", F.lit(2**30)), "file")) - 1  # of names only
    ranked = rows.select("project", "file").join(listed, ["project", "file"], "left").select("project", "file", rank.cast("int").alias("file_ord"))
    return rows.join(ranked, ["project", "file"]).select("project", "file", "file_ord", "text")


def read_sections(spark: SparkSession, project: str, src: str = "paper/sections", manifest: str = "paper/paper.yaml") -> DataFrame:
    """project, file, file_ord, text; files the manifest does not list follow by name."""
    path = f"{project}/{manifest}"
    return _in_order(spark, f"{project}/{src}", path if exists(spark, path) else None, lambda _: F.lit(PurePosixPath(project).name))


def _below(root: str) -> Callable[[str], Column]:
    """The project's folder name, from paths that match a pattern ``root/*/...``."""
    return lambda pattern: F.element_at(F.split("path", "/"), -(len(pattern[len(root) + 1 :].split("/")) + (0 if pattern.rpartition(".")[2] in ("yaml", "json") else 1)))


def read_projects(spark: SparkSession, root: str, src: str = "paper/sections", manifest: str = "paper/paper.yaml") -> DataFrame:
    """The sections of all projects, the folders in ``root``, in one job; each manifest orders its own files."""
    root = root.rstrip("/")
    path = f"{root}/*/{manifest}"
    return _in_order(spark, f"{root}/*/{src}", path if matches(spark, path) else None, _below(root))


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern names any file."""
    fs, target = _fs(spark, pattern)
    return bool(fs.globStatus(target))


def read_plans(spark: SparkSession, root: str) -> DataFrame:
    """project, value: the plans of all projects in ``root`` that have one."""
    path = f"{root.rstrip('/')}/*/frame/frame_plan.json"
    if not matches(spark, path):
        return spark.createDataFrame([], "project string, value string")
    return spark.read.format("binaryFile").load(path).select(_below(root.rstrip("/"))(path).alias("project"), F.decode("content", "utf-8").alias("value"))


def digests(spark: SparkSession, project: str, src: str = "paper/sections") -> DataFrame:
    """project, file, sha: SHA-256 of the bytes of each section file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{project}/{src}")
    return files.select(F.lit(PurePosixPath(project).name).alias("project"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha"))


def read_plan(spark: SparkSession, path: str, project: str) -> DataFrame:
    """project, value: the JSON of a plan, for :func:`vellum.plans.outline.parse_plan`."""
    return spark.createDataFrame([(project, read_text(spark, path))], "project string, value string")


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array with a fixed schema (roles, terms, norms)."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, int, str, bool]]:
    """A role rule table in order of priority; a table of rules is a page."""
    rows = read_json_rows(spark, path, RULES).orderBy("priority").collect()
    return [(r["role"], r["level"], r["pattern"], bool(r["strict_level"])) for r in rows]


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A term map."""
    return read_json_rows(spark, path, TERMS)


def read_term_bank(spark: SparkSession, path: str) -> DataFrame:
    """term: a JSON array of words, or of objects with ``term``."""
    held = spark.read.format("binaryFile").load(path).select(F.explode(F.from_json(F.decode("content", "utf-8"), "array<string>")).alias("x"))
    return held.select(F.trim(F.coalesce(F.get_json_object("x", "$.term"), "x")).alias("term")).filter("term <> ''").distinct()


def read_project_terms(spark: SparkSession, project: str) -> DataFrame | None:
    """project, term: words a project has confirmed, if it has such a list (strings or objects with ``term``)."""
    path = f"{project}/frame/FRAME_TERMS.json"
    if not exists(spark, path):
        return None
    held = json.loads(read_text(spark, path))
    held = held.get("terms", []) if isinstance(held, dict) else held
    words = [(PurePosixPath(project).name, x if isinstance(x, str) else x["term"]) for x in held]
    return spark.createDataFrame(words, "project string, term string")


def pdf_toc(content: bytes) -> list[tuple[int, str]]:
    """Level and title of the entries of a PDF's outline; needs pymupdf."""
    import pymupdf

    return [(level, title) for level, title, *_ in pymupdf.open(stream=content, filetype="pdf").get_toc()]


PDF = "file string, level int, title string, error string"


def read_pdfs(spark: SparkSession, path: str, toc: Callable[[bytes], list[tuple[int, str]]] = pdf_toc) -> DataFrame:
    """file, level, title, error: a row an entry of each outline that ``toc`` reads on the executors, or a row with what went wrong.

    A damaged or encrypted document is a row with its error and no title; the others are read all the same.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(file, level, title, None) for level, title in toc(content)]
                except ImportError:
                    raise  # the reader itself is missing: no document can be read
                except Exception as e:
                    rows = [(file, None, None, f"{type(e).__name__}: {e}")]
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "level", "title", "error"])

    return files.mapInArrow(run, PDF)


def read_pdf_outlines(spark: SparkSession, path: str, toc: Callable[[bytes], list[tuple[int, str]]] = pdf_toc) -> DataFrame:
    """file, level, title of the outlines of PDF documents that can be read."""
    return read_pdfs(spark, path, toc).filter("error is null").select("file", "level", "title")


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """file, level, title: a JSON array of outlines, or a folder of PDF documents."""
    return read_json_rows(spark, path, OUTLINES) if path.endswith(".json") else read_pdf_outlines(spark, path)


def _stream(uri: str):
    """The file system of a folder as the executors see it, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def _put(store, path: str, spare: str, text: str) -> int:
    """``text`` at ``path``, by way of ``spare``; a task that runs again puts the same bytes there."""
    data = text.encode("utf-8")
    with store.open_output_stream(spare) as out:
        out.write(data)
    store.move(spare, path)
    return len(data)


def write_folders(files: DataFrame, root: str, folder: str) -> dict[str, int]:
    """Each row (project, file, text) as ``root/project/folder/file``, a folder replaced as a whole; files by project.

    The executors write into a folder beside the target.  Only when every file of every
    project is there, each folder takes the place of the old one by a rename; if a task
    fails for good, or a count is wrong, the old folders stay as they are.  Files of an older
    run go with the old folder.
    """
    spark, token = files.sparkSession, uuid.uuid4().hex
    root = root.rstrip("/")
    parent, _, name = folder.rpartition("/")
    aside = lambda project, mark: f"{root}/{project}/{parent}/.{name}-{mark}-{token}".replace("//.", "/.")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for batch in batches:
            done = []
            for project, file, text in zip(*(batch.column(c).to_pylist() for c in ("project", "file", "text")), strict=True):
                store, path = _stream(aside(project, "new"))
                _put(store, f"{path}/{file}", f"{path}/.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}", text)
                done.append((project, file))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["project", "file"])

    rows = files.select("project", "file", "text")
    projects = [r[0] for r in rows.select("project").distinct().collect()]
    try:
        for project in projects:  # not by the tasks: one that still runs when another has failed would make its folder again
            store, path = _fs(spark, aside(project, "new"))
            store.mkdirs(path)
        written = rows.mapInArrow(run, "project string, file string")
        counts = {r["project"]: r["n"] for r in written.groupBy("project").agg(F.count_distinct("file").alias("n")).collect()}
        wanted = {r["project"]: r["n"] for r in rows.groupBy("project").agg(F.count("*").alias("n")).collect()}
        if counts != wanted:
            raise ValueError("two rows for a file, or rows that were not written")
    except Exception:
        for project in projects:
            _delete(spark, aside(project, "new"))
        raise
    for project in projects:
        _swap(spark, aside(project, "new"), f"{root}/{project}/{folder}", aside(project, "old"))
    return counts


def write_files(files: DataFrame, root: str) -> int:
    """Each row (project, file, text) as ``root/project/file`` by the executors, one file replaced at a time; their number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for project, file, text in zip(*(batch.column(c).to_pylist() for c in ("project", "file", "text")), strict=True):
                store, path = _stream(f"{root.rstrip('/')}/{project}/{file}")
                folder, _, name = path.rpartition("/")
                store.create_dir(folder, recursive=True)
                _put(store, path, f"{folder}/.{name}-{uuid.uuid4().hex}", text)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("project", "file", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def _swap(spark: SparkSession, new: str, target: str, old: str) -> None:
    """``new`` in the place of ``target``; what was there goes, or comes back if the second step fails."""
    fs, there = _fs(spark, target)
    fresh, spare = (_fs(spark, p)[1] for p in (new, old))
    had = fs.exists(there)
    if had and not fs.rename(there, spare):
        raise OSError(f"cannot put {target} aside")
    if not fs.rename(fresh, there):
        if had:
            fs.rename(spare, there)
        raise OSError(f"cannot put {new} in place of {target}")
    if had:
        fs.delete(spare, True)


def write_sections(sections: DataFrame, folder: str) -> None:
    """Each row (file, text) as ``folder/file``; the folder is replaced as a whole."""
    root, project, parent, name = folder.rsplit("/", 3)
    write_folders(sections.select(F.lit(project).alias("project"), "file", "text"), root, f"{parent}/{name}")
