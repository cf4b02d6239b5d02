"""Files of pairs as Spark data sources: documents with both of their texts in, a record and a page for each pair out.

Both sources reach their files by pyarrow's file systems, so a path may be local, ``file:``, ``hdfs:``, ``s3:`` or ``gs:``.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import quote, unquote

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: What a reader makes of a file: for each page its layout text, and its flat text, in which positions count for nothing, or None.
Pages = list[tuple[str, "str | None"]]
DOCUMENT_FILES = "pair_id string, doc_key string, name string, file_sha256 string, text string, flat_pages array<string>, error string"
PAIR_FILES = "pair_id string, record string, page string"
#: Names of a pair's files.
RECORD_NAME, PAGE_NAME = "findings.json", "review-sheet.html"


def text_pages(content: bytes) -> Pages:
    """Layout text with form feeds between pages; there is no flat text."""
    return [(page, None) for page in content.decode().split("\f")]


def json_pages(content: bytes) -> Pages:
    """A JSON array of pages, each an object with layout and flat."""
    return [(page.get("layout") or "", page.get("flat")) for page in json.loads(content)]


def pdf_pages(content: bytes) -> Pages:
    """Both extractions of a PDF's pages, by pypdf where that is installed."""
    import io

    from pypdf import PdfReader

    return [(p.extract_text(extraction_mode="layout") or "", p.extract_text() or "") for p in PdfReader(io.BytesIO(content)).pages]


READERS: dict[str, Callable[[bytes], Pages]] = {"text": text_pages, "json": json_pages, "pdf": pdf_pages}
GLOBS = {"text": "*.txt", "json": "*.json", "pdf": "*.pdf"}


def _reader(name: str) -> Callable[[bytes], Pages]:
    if name in READERS:
        return READERS[name]
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def folder_name(pair_id: str) -> str:
    """A folder's name for a pair, whatever characters its id has."""
    name = quote(pair_id, safe=" ")
    return name.replace(".", "%2E") if name.strip(".") == "" else name


@dataclass
class FileRange(InputPartition):
    paths: list[str]


class _DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.reader = options.get("reader", "text")
        self.glob = options.get("glob", GLOBS.get(self.reader, "*"))
        self.most = int(options.get("maxPartitionBytes", 32 << 20))
        self.open_cost = int(options.get("openCostInBytes", 64 << 10))
        self.missing = options.get("missing", "error")
        self.wanted: dict[str, set] = {}

    def _files(self) -> list:
        fs, root = pafs.FileSystem.from_uri(self.path)
        roots = [root] if "pair_id" not in self.wanted else [posixpath.join(root, folder_name(p)) for p in sorted(self.wanted["pair_id"])]
        found = [x for r in roots for x in fs.get_file_info(pafs.FileSelector(r, recursive=True, allow_not_found=r != root or self.missing == "none"))]
        keys = self.wanted.get("doc_key")
        return sorted((x for x in found if x.type == pafs.FileType.File and fnmatch(x.base_name, self.glob) and (keys is None or posixpath.splitext(x.base_name)[0] in keys)), key=lambda x: x.path)

    def partitions(self) -> list[FileRange]:
        ranges, size = [[]], 0
        for x in self._files():
            cost = (x.size or 0) + self.open_cost
            if ranges[-1] and size + cost > self.most:
                ranges.append([])
                size = 0
            ranges[-1].append(x.path)
            size += cost
        return [FileRange(r) for r in ranges if r]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        parse = _reader(self.reader)
        for path in partition.paths if partition else ():
            folder, name = posixpath.split(path)
            pair_id, doc_key = unquote(posixpath.basename(folder)), posixpath.splitext(name)[0]
            digest = None
            try:
                with fs.open_input_stream(path) as f:
                    content = f.read()
                digest = hashlib.sha256(content).hexdigest()
                pages = parse(content)
                flat = [x for _, x in pages]
                yield pair_id, doc_key, name, digest, "\f".join(x or "" for x, _ in pages), [x or "" for x in flat] if any(x is not None for x in flat) else None, None
            except Exception as e:  # noqa: BLE001  whatever a reader raises over one file; the others are read
                yield pair_id, doc_key, name, digest, None, None, f"{type(e).__name__}: {e}"[:400]


class _PruningReader(_DocumentReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("pair_id", "doc_key"):
                values = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f


class DocumentFiles(DataSource):
    """``spark.read.format("pair_documents").load(path)``: DOCUMENT_FILES of ``<path>/<pair_id>/<doc_key>.<ending>``.

    Options: reader, a name of READERS or ``module:function``; glob; maxPartitionBytes and openCostInBytes, which set how
    many files a task reads; prune, ``true`` where spark.sql.python.filterPushdown.enabled is set, so that equality with
    pair_id or doc_key, and IN lists, keep other files from being listed or read (document_files sees to it); missing,
    ``none`` where a folder that isn't there has no files. A file that can't be read or parsed is a row with an error and no text.
    """

    @classmethod
    def name(cls) -> str:
        return "pair_documents"

    def schema(self) -> str:
        return DOCUMENT_FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return (_PruningReader if self.options.get("prune") == "true" else _DocumentReader)(self.options)


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class _PairWriter(DataSourceWriter):
    """Two phases: tasks write whole folders of pairs beside the others, the commit moves each to its place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _folder(self, kind: str) -> tuple[pafs.FileSystem, str, str]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, root, posixpath.join(root, f".{kind}-{self.run}")

    def write(self, iterator: Iterator) -> Staged:
        fs, root, staging = self._folder("staged")
        # an attempt has a folder of its own: one that failed, or that lost a race, is never moved
        mine = posixpath.join(staging, f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        fs.create_dir(mine, recursive=True)
        for row in iterator:
            pair = posixpath.join(mine, folder_name(row["pair_id"]))
            if fs.get_file_info(pair).type != pafs.FileType.NotFound:
                raise ValueError(f"pair {row['pair_id']} comes more than once")
            fs.create_dir(pair)
            for name, text in ((RECORD_NAME, row["record"]), (PAGE_NAME, row["page"])):
                with fs.open_output_stream(posixpath.join(pair, name)) as f:
                    f.write(text.encode())
        return Staged(posixpath.basename(mine))

    def commit(self, messages: list) -> None:
        fs, root, staging = self._folder("staged")
        _, _, replaced = self._folder("replaced")
        names = lambda folder: {x.base_name: x.path for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))}
        new: dict[str, str] = {}
        for m in messages:
            for name, path in names(posixpath.join(staging, m.folder)).items() if m else ():
                if name in new:
                    self.abort(messages)
                    raise ValueError(f"pair {unquote(name)} comes more than once")
                new[name] = path
        there = {k: p for k, p in names(root).items() if not k.startswith(".")}
        fs.create_dir(replaced, recursive=True)

        def place(name: str) -> None:
            if name in there:
                fs.move(there[name], posixpath.join(replaced, name))
            if name in new:
                fs.move(new[name], posixpath.join(root, name))

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(place, sorted(new.keys() | there.keys() if self.overwrite else new)))
        for folder in (staging, replaced):
            fs.delete_dir(folder)

    def abort(self, messages: list) -> None:  # noqa: ARG002
        fs, _, staging = self._folder("staged")
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class PairFiles(DataSource):
    """``df.write.format("pair_files").mode("append").save(path)`` of PAIR_FILES: ``<path>/<pair_id>/`` with a record and a page.

    A pair's files appear together, by one move of their folder, after every task has ended; if a task fails for good,
    nothing changes. Append replaces pairs that are there already; overwrite also removes those that aren't written. The
    driver makes one move for each pair, sixteen at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "pair_files"

    def schema(self) -> str:
        return PAIR_FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ARG002
        return _PairWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
    spark.dataSource.register(PairFiles)


def document_files(spark: SparkSession, path: str, reader: str = "text", **options: str) -> DataFrame:
    register(spark)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("pair_documents").option("reader", reader).option("prune", prune).options(**options).load(path)


def write_pair_files(files: DataFrame, path: str, mode: str = "append") -> None:
    register(files.sparkSession)
    files.select("pair_id", "record", "page").write.format("pair_files").mode(mode).save(path)


def remove_pair_files(pairs: DataFrame, path: str) -> None:
    """Removes the folders of pairs (pair_id), from tasks; those that aren't there are passed over."""

    def remove(rows: Iterator) -> None:
        fs, root = pafs.FileSystem.from_uri(path)
        for row in rows:
            folder = posixpath.join(root, folder_name(row["pair_id"]))
            if fs.get_file_info(folder).type != pafs.FileType.NotFound:
                fs.delete_dir(folder)

    pairs.select("pair_id").foreachPartition(remove)
