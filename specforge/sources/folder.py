"""A folder of delimited files and JSON lines as a data source: spark.read.format("catalogue_folder").load(folder).

Every file has a delimiter and a header of its own. A file is one partition, or with rangeBytes one for each byte range
of a file whose rows are lines; then a row is named by where it begins. What cannot be a record is a row too, with its
level (skipped, warning, error) and a reason, so that one file never fails the others. As a stream, the offset is the
time of the newest file and the files of that time.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "catalogue_folder"
SCHEMA = "source string, source_ref string, name string, description string, category string, sku string, attributes map<string,string>, file string, level string, reason string"
ENDINGS = {".csv": "csv", ".tsv": "csv", ".jsonl": "json", ".ndjson": "json"}
HEAD = 1 << 16
BATCH = 5000


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int  # 0: the whole file
    header: list[str] | None = None
    delimiter: str = ","


def _kind(path: str) -> str | None:
    return next((k for end, k in ENDINGS.items() if path.lower().endswith(end)), None)


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def delimiter_of(path: str, head: str) -> str:
    """TAB for .tsv; else the delimiter that the first line with text holds most often."""
    from .readers import sniff

    return "\t" if path.lower().endswith(".tsv") else sniff(next((x for x in head.splitlines() if x.strip()), ""))


class Folder:
    """Files of a folder in any file system that pyarrow opens, by URI or absolute path."""

    def __init__(self, options: dict):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(options["path"])
        self.given = options.get("delimiter")
        self.range = int(options.get("rangebytes", options.get("rangeBytes", 0)))
        self.selector, self.file_type = fs.FileSelector, fs.FileType

    def files(self) -> list[tuple[int, str, int]]:
        """(time, path, size) of the files that are read, oldest first."""
        info = self.fs.get_file_info(self.root)
        found = self.fs.get_file_info(self.selector(self.root, recursive=True)) if info.type == self.file_type.Directory else [info]
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == self.file_type.File and _kind(f.path))

    def parts(self, files: list[tuple[int, str, int]]) -> list[Part]:
        out = []
        for _, path, size in files:
            header, delimiter = None, ","
            if _kind(path) == "csv":
                with self.fs.open_input_stream(path) as f:
                    head = _text(f.read(HEAD))
                delimiter = self.given or delimiter_of(path, head)
                header = next((r for r in csv.reader(io.StringIO(head), delimiter=delimiter) if any(c.strip() for c in r)), [])
            if self.range and size > self.range:
                out += [Part(path, a, min(a + self.range, size), header, delimiter) for a in range(0, size, self.range)]
            else:
                out.append(Part(path, 0, 0, header, delimiter))
        return out

    def lines(self, part: Part) -> Iterator[tuple[int, str]]:
        """(offset, line) of the lines that begin in a byte range."""
        with self.fs.open_input_file(part.path) as f:
            at = part.start
            if at:
                f.seek(at - 1)
                rest = b""
                while (block := f.read(HEAD)) and b"\n" not in block:
                    at += len(block)
                if not block:
                    return
                at += block.index(b"\n")
                f.seek(at)
            rest = b""
            while at < part.stop:
                cut = rest.find(b"\n")
                if cut < 0:
                    block = f.read(HEAD)
                    if not block:
                        if rest:
                            yield at, _text(rest)
                        return
                    rest += block
                    continue
                yield at, _text(rest[:cut].removesuffix(b"\r"))
                at, rest = at + cut + 1, rest[cut + 1 :]

    def whole(self, part: Part) -> str:
        with self.fs.open_input_stream(part.path) as f:
            return _text(f.read())

    def rows(self, part: Part) -> Iterator[dict]:
        name = part.path.rsplit("/", 1)[-1]
        body = _delimited if _kind(part.path) == "csv" else _json_lines
        for row in body(self, part, name):
            yield {"source": "csv" if body is _delimited else "json", "file": name, "level": "record", **row}

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c.split()[0], pa.map_(pa.string(), pa.string()) if "map" in c else pa.string()) for c in SCHEMA.split(", ")])
        held: list[dict] = []
        for row in self.rows(part):
            held.append(row | {"attributes": list((row.get("attributes") or {}).items())})
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)


def _tidy(x: object) -> str:
    return "" if x is None else " ".join(str(x).split())


def _record(fields: dict[str, object], roles: dict[str, str | None], ref: str) -> dict:
    values = {role: _tidy(fields.get(key)) if key else "" for role, key in roles.items()}
    if not values["name"]:
        return {"source_ref": ref, "level": "skipped", "reason": "empty product name"}
    rest = {k.strip(): _tidy(v) for k, v in fields.items() if k and k.strip() and k not in roles.values() and _tidy(v)}
    return {"source_ref": ref, **values, "attributes": rest}


def _delimited(folder: Folder, part: Part, name: str) -> Iterator[dict]:
    from .readers import map_columns

    roles = map_columns(part.header or [])
    if roles["name"] is None:
        if part.start == 0:
            yield {"source_ref": name, "level": "error", "reason": f"no product name among the columns {part.header}" if part.header else "the file is empty"}
        return
    if roles["description"] is None and part.start == 0:
        yield {"source_ref": name, "level": "warning", "reason": "no description column"}
    if part.stop:
        numbered = ((f"{name}#byte{at}", next(csv.reader([line], delimiter=part.delimiter), [])) for at, line in folder.lines(part) if line.strip())
    else:
        numbered = ((f"{name}#row{i}", row) for i, row in enumerate((r for r in csv.reader(io.StringIO(folder.whole(part)), delimiter=part.delimiter) if r), 1))
    for ref, row in numbered:
        if row == part.header and ref.endswith(("#row1", "#byte0")):
            continue
        yield _record(dict(zip(part.header, row, strict=False)), roles, ref)


def _json_lines(folder: Folder, part: Part, name: str) -> Iterator[dict]:
    from .readers import flat_object, map_columns

    if part.stop:
        numbered = ((f"{name}#byte{at}", line) for at, line in folder.lines(part))
    else:
        numbered = ((f"{name}#{i}", line) for i, line in enumerate((x for x in folder.whole(part).splitlines() if x.strip()), 1))
    for ref, line in numbered:
        if not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError:
            yield {"source_ref": ref, "level": "warning", "reason": "no valid JSON"}
            continue
        if isinstance(value, dict):
            fields = dict(flat_object(value))
            yield _record(fields, map_columns(list(fields)), ref)
        else:
            yield {"source_ref": ref, "level": "skipped", "reason": "no JSON object"}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Part]:
        folder = Folder(self.options)
        return folder.parts(folder.files())

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return Folder(self.options).read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "files": []}

    def latestOffset(self) -> dict:  # noqa: N802
        files = Folder(self.options).files()
        last = files[-1][0] if files else -1
        return {"time": last, "files": [p for t, p, _ in files if t == last]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        folder = Folder(self.options)
        new = lambda t, p: t > start["time"] or t == start["time"] and p not in start["files"]
        old = lambda t, p: t < end["time"] or t == end["time"] and p in end["files"]
        return folder.parts([f for f in folder.files() if new(*f[:2]) and old(*f[:2])])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return Folder(self.options).read(partition)


class CatalogueFolder(DataSource):
    """Options: path, delimiter (of all delimited files), rangeBytes (0: whole files, whose quoted values may hold line ends)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


def read_folder(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """All rows of a folder of files, records and what else there is."""
    spark.dataSource.register(CatalogueFolder)
    return spark.read.format(NAME).options(**options).load(path)


def read_folder_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(CatalogueFolder)
    return spark.readStream.format(NAME).options(**options).load(path)


def report(rows: DataFrame) -> DataFrame:
    """file, records, skipped, errors and warnings (texts, a few per file) of each file."""
    is_ = lambda level: F.col("level") == level
    texts = F.slice(F.array_sort(F.collect_set(F.when(~is_("record") & ~is_("skipped"), F.col("reason")))), 1, 20)
    return rows.groupBy("file").agg(F.count_if(is_("record")).alias("records"), F.count_if(is_("skipped")).alias("skipped"), F.count_if(is_("error")).alias("errors"), texts.alias("warnings"))
