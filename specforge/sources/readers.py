"""Catalogue files in: CSV, JSON, HTML, text, PDF, Excel. Every reader gives records and rejects, and invents nothing.

Records have source, source_ref, name, description, category, sku and attributes; rejects have source_ref and reason. A
matched part number is kept in sku, and headers are trimmed before they are matched.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixed import CATEGORY_COLUMNS, DESCRIPTION_COLUMNS, NAME_COLUMNS, SKU_COLUMNS, WRAPPERS
from ..functions.sql import let
from ..functions.text import clean, is_heading, key_value_map, stripped
from .pages import page

RECORD = ("source", "source_ref", "name", "description", "category", "sku", "attributes")
KINDS = {"csv": ".csv", "tsv": ".tsv", "json": ".json .jsonl .ndjson", "html": ".html .htm", "text": ".txt .md .text", "pdf": ".pdf", "xlsx": ".xlsx .xlsm"}
#: Part of a content type -> kind
MIMES = {"pdf": "pdf", "spreadsheet": "xlsx", "tab-separated": "tsv", "csv": "csv", "json": "json", "html": "html", "text/plain": "text"}
ROLES = {"name": NAME_COLUMNS, "description": DESCRIPTION_COLUMNS, "category": CATEGORY_COLUMNS, "sku": SKU_COLUMNS}


def normal(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")


def map_columns(headers: list[str]) -> dict[str, str | None]:
    """Which header plays which role: the best candidate that equals one, else the best that ends one."""
    known = [(h, normal(h)) for h in headers if h and h.strip()]

    def find(candidates: list[str]) -> str | None:
        same = (h for c in candidates for h, n in known if n == c)
        ends = (h for c in candidates for h, n in known if n.endswith("_" + c))
        return next(same, None) or next(ends, None)

    return {role: find(candidates) for role, candidates in ROLES.items()}


def _role(fields: Column, role: str) -> Column:
    """The key of a map that plays a role, as map_columns finds it, per record."""
    keys = F.map_keys(fields)
    names = F.transform(keys, lambda k: F.btrim(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), F.lit("_")))
    candidates = F.array(*map(F.lit, ROLES[role]))
    same = F.get(F.filter(F.transform(candidates, lambda c: F.get(keys, (F.array_position(names, c) - 1).cast("int"))), lambda x: x.isNotNull()), 0)
    ends = F.get(F.filter(F.transform(candidates, lambda c: F.get(F.filter(keys, lambda k, i: F.endswith(F.get(names, i), F.concat(F.lit("_"), c))), 0)), lambda x: x.isNotNull()), 0)
    return F.coalesce(same, ends)


def from_maps(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of rows with source_ref and fields (a map); which key is the name may differ by row."""
    roles = df.select("source_ref", "fields", *[_role(F.col("fields"), r).alias(f"k_{r}") for r in ROLES])
    value = lambda r: clean(F.try_element_at("fields", F.col(f"k_{r}"))).alias(r)
    taken = F.array_compact(F.array(*[F.col(f"k_{r}") for r in ROLES]))
    rest = F.map_filter(F.transform_values("fields", lambda k, v: clean(v)), lambda k, v: (v != "") & (F.trim(k) != "") & ~F.array_contains(taken, k))
    rows = roles.select(F.lit(source).alias("source"), "source_ref", *map(value, ROLES), rest.alias("attributes"))
    return rows.filter("name <> ''").select(*RECORD), rows.filter("name = ''").select("source_ref", F.lit("no name").alias("reason"))


def sniff(line: str) -> str:
    """The delimiter that a header line holds most often; a comma if none."""
    return max(",;\t|", key=lambda d: (line.count(d), d == ","))


def _numbered(df: DataFrame) -> DataFrame:
    """df with row, the number of a row in its file: counts of the file's blocks are summed, no row moves."""
    marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    blocks = marked.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("_n")
    first = blocks.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_least", before.alias("_before"))
    same = (marked["_file"] == first["_f"]) & (marked["_start"] == first["_s"])
    return marked.join(first, same).withColumn("row", F.col("_before") + F.col("_id") - F.col("_least")).drop("_f", "_s", "_least", "_before", "_id", "_start")


def _heads(spark: SparkSession, path: str, most: int = 100_000) -> list[tuple[str, str]]:
    """The path of each file and its first line with text. An error if there are more than most files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value").filter(F.trim("value") != "")
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "id")).alias("head")).orderBy("file").limit(most + 1).collect()
    if len(first) > most:
        raise ValueError(f"more than {most} files; read them in parts")
    return [(r["file"], r["head"].lstrip("\ufeff")) for r in first]


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of delimited files, each with a header of its own; source_ref is file#rowN, where the header is row 1.

    Files with one header and delimiter are read together; a .tsv file is cut at TABs. A file without a product name
    among its headers is a reject, and an error if there is no other. Quoted values may hold line ends; with
    multi_line=False they may not, and large files are read in parts.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for file, head in _heads(spark, path):
        cut = delimiter or ("\t" if file.lower().endswith(".tsv") else sniff(head))
        groups.setdefault((cut, head), []).append(file)
    if not groups:
        raise ValueError("the file is empty")
    found, nameless = [], []
    for (cut, head), files in groups.items():
        headers = next(csv.reader([head], delimiter=cut))
        if map_columns(headers)["name"] is None:
            nameless += [(f.rsplit("/", 1)[-1], f"no product name among the columns {headers}") for f in files]
        else:
            found.append(_read_alike(spark, files, headers, cut, multi_line))
    if not found:
        raise ValueError(nameless[0][1])
    records, rejects = found[0]
    for r, x in found[1:]:
        records, rejects = records.unionByName(r), rejects.unionByName(x)
    return records, rejects.unionByName(spark.createDataFrame(nameless, "source_ref string, reason string")) if nameless else rejects


def _read_alike(spark: SparkSession, files: list[str], headers: list[str], delimiter: str, multi_line: bool) -> tuple[DataFrame, DataFrame]:
    roles = map_columns(headers)
    names = [f"c{i}" for i in range(len(headers))]
    schema = ", ".join(f"{n} string" for n in names)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", delimiter).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(files)
    at = {h: F.col(n) for h, n in zip(headers, names, strict=True)}
    pick = lambda r: (clean(at[roles[r]]) if roles[r] else F.lit("")).alias(r)
    rest = [h for h in headers if h.strip() and h not in roles.values()]
    attributes = F.map_filter(F.create_map(*[x for h in rest for x in (F.lit(h.strip()), clean(at[h]))]) if rest else F.expr("cast(map() as map<string,string>)"), lambda k, v: v != "")
    ref = F.concat(F.regexp_extract("_file", r"([^/]*)$", 1), F.lit("#row"), (F.col("row") + 2).cast("string"))
    rows = _numbered(raw).select(F.lit("csv").alias("source"), ref.alias("source_ref"), *map(pick, ROLES), attributes.alias("attributes"))
    return rows.filter("name <> ''").select(*RECORD), rows.filter("name = ''").select("source_ref", F.lit("empty product name").alias("reason"))


def flat_object(value: dict, before: str = "") -> Iterator[tuple[str, str | None]]:
    """The scalar leaves of an object, nested keys joined by underscores; lists as their scalars, joined by commas."""
    for k, v in value.items():
        if isinstance(v, dict):
            yield from flat_object(v, f"{before}{k}_")
        elif isinstance(v, list):
            yield before + k, ", ".join(str(x) for x in v if not isinstance(x, dict | list))
        else:
            yield before + k, None if v is None else str(v)


def _scalar(x: str) -> str:
    """SQL of a scalar variant as text: true and false with a capital, a number that was written with a point keeps it."""
    text = f"try_variant_get({x}, '$', 'string')"
    return f"CASE WHEN schema_of_variant({x}) = 'BOOLEAN' THEN initcap({text}) WHEN startswith(schema_of_variant({x}), 'DECIMAL') AND NOT contains({text}, '.') THEN concat({text}, '.0') ELSE {text} END"


def flatten_sql(text: str, depth: int = 12) -> str:
    """SQL of a JSON object as a map of its scalar leaves, nested keys joined by underscores; null for anything else.

    Variants are opened level by level, without a generator and in the JVM; what lies deeper than depth stays JSON text.
    Top keys keep their order, nested ones are in alphabetical order. Of equal joined keys the last counts.
    """
    object_ = lambda x: f"startswith(schema_of_variant({x}), 'OBJECT')"
    entries = lambda x: f"try_variant_get({x}, '$', 'map<string,variant>')"
    opened = f"flatten(transform(e, x -> if({object_('x.value')}, transform(map_entries({entries('x.value')}), y -> named_struct('key', concat(x.key, '_', y.key), 'value', y.value)), array(named_struct('key', x.key, 'value', x.value)))))"
    items = f"array_join(transform(filter(try_variant_get(x.value, '$', 'array<variant>'), z -> NOT {object_('z')} AND NOT startswith(schema_of_variant(z), 'ARRAY')), z -> coalesce({_scalar('z')}, 'None')), ', ')"
    leaves = f"transform(e, x -> named_struct('key', x.key, 'value', if(startswith(schema_of_variant(x.value), 'ARRAY'), {items}, {_scalar('x.value')})))"
    unique = let(leaves, "l", "map_from_entries(filter(l, (a, i) -> NOT exists(slice(l, i + 2, size(l)), b -> b.key = a.key)))")
    body = let(entries("v"), "m", f"filter(transform(json_object_keys({text}), k -> named_struct('key', k, 'value', element_at(m, k))), p -> p.value IS NOT NULL)")
    deeper = "e"
    for _ in range(depth):  # a record is opened only as deep as it goes
        deeper = f"if(exists(e, x -> {object_('x.value')}), {let(opened, 'e', deeper)}, e)"
    flat = let(body, "e", let(deeper, "e", unique))
    return let(f"try_parse_json({text})", "v", f"if(v IS NULL OR NOT {object_('v')}, null, {flat})")


def from_json(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of rows with source_ref and content: an array, an object around one, one object, or JSON lines."""
    kind = "array<string>"
    whole = F.try_parse_json("content")
    text = stripped(F.col("content"))
    wrapped = F.coalesce(*[F.when(F.get_json_object("content", f"$.{w}").startswith("["), F.get_json_object("content", f"$.{w}")) for w in WRAPPERS])
    listed = F.when(text.startswith("["), F.from_json(text, kind)).when(wrapped.isNotNull(), F.from_json(wrapped, kind)).otherwise(F.array(text))
    lines = F.filter(F.split(F.col("content"), r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    # The parser stops after the first value: an object that ends with its line, and lines after it, are JSON lines.
    several = (F.size(lines) > 1) & stripped(F.get(lines, F.lit(0))).rlike(r"^\{.*\}$")
    items = docs.select("source_ref", F.when(whole.isNotNull() & ~several, listed).otherwise(lines).alias("items"))
    each = items.select("source_ref", F.posexplode("items").alias("at", "item"))
    ref = F.concat("source_ref", F.lit("#"), (F.col("at") + 1).cast("string")).alias("source_ref")
    # Through a generator of one row: neither filters nor the columns that follow unfold the long expression again.
    read = each.select(ref, "item").selectExpr("source_ref", f"inline(array(named_struct('fields', {flatten_sql('item')})))")
    records, rejects = from_maps(read.filter("fields IS NOT NULL"), "json")
    return records, rejects.union(read.filter("fields IS NULL").select("source_ref", F.lit("no JSON object").alias("reason")))


def from_html(docs: DataFrame, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """One record per page of rows with source_ref and content; pages without heading and title are rejected. closed: only references with a semicolon are read."""

    @F.pandas_udf("name string, description string, attributes map<string,string>")
    def read(pages: pd.Series) -> pd.DataFrame:
        found = [page(p, closed) or {"name": None, "description": None, "attributes": None} for p in pages]
        return pd.DataFrame(found, columns=["name", "description", "attributes"])

    rows = docs.select("source_ref", read(F.col("content")).alias("p")).select("source_ref", "p.*")
    none = F.lit("")
    records = rows.filter("name IS NOT NULL").select(F.lit("html").alias("source"), "source_ref", "name", "description", none.alias("category"), none.alias("sku"), "attributes")
    return records, rows.filter("name IS NULL").select("source_ref", F.lit("neither heading nor title").alias("reason"))


def from_text(docs: DataFrame, split: bool = True, source: str = "document") -> tuple[DataFrame, DataFrame]:
    """A record per heading of rows with source_ref and content; without headings one named by its first line.

    What stands before the first heading is left out. Empty documents are rejected. Lines stay in their row: no shuffle.
    """
    text = stripped(F.coalesce("content", F.lit("")))
    lines = docs.select("source_ref", text.alias("whole"), F.transform(F.split(text, r"\r\n|\n|\r"), stripped).alias("lines"))
    heads = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: is_heading(F.get("lines", i)) & F.lit(split))
    placed = lines.withColumn("heads", heads)
    after = lambda j: F.coalesce(F.get("heads", j + 1), F.size("lines"))
    block = lambda i, j: F.struct(F.get("lines", i).alias("name"), F.slice("lines", i + 2, after(j) - i - 1).alias("body"))
    one = F.array(F.struct(F.substring(F.get("lines", F.lit(0)), 1, 120).alias("name"), F.array("whole").alias("body")))
    blocks = placed.filter("whole <> ''").select("source_ref", F.posexplode(F.when(F.size("heads") > 0, F.transform("heads", block)).otherwise(one)).alias("at", "b"))
    body = stripped(F.array_join("b.body", "\n"))
    lines_of = F.split(body, r"\r\n|\n|\r")
    ref = F.concat("source_ref", F.lit("#block"), (F.col("at") + 1).cast("string"))
    records = blocks.select(F.lit(source).alias("source"), ref.alias("source_ref"), "b.name", body.alias("description"), F.lit("").alias("category"), F.lit("").alias("sku"), key_value_map(lines_of).alias("attributes"))
    return records, placed.filter("whole = ''").select("source_ref", F.lit("empty document").alias("reason"))


def csv_contents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of rows with source_ref and content, each a small delimited file with a header of its own.

    The name's ending decides before the content: a .tsv file, or one whose content_type says so, is cut at TABs.
    """

    @F.pandas_udf("array<struct<row:int,fields:map<string,string>>>")
    def rows(texts: pd.Series, tabs: pd.Series) -> pd.Series:
        def one(t: str | None, tab: bool) -> list:
            first = next((x for x in (t or "").splitlines() if x.strip()), "")
            read = csv.DictReader(io.StringIO(t or ""), delimiter="\t" if tab else sniff(first))
            return [{"row": i, "fields": {(k or "").strip(): v for k, v in r.items() if isinstance(v, str) and k}} for i, r in enumerate(read, 2)]

        return pd.Series([one(t, tab) for t, tab in zip(texts, tabs, strict=True)], dtype=object)

    told = F.coalesce(F.lower("content_type").contains("tab-separated"), F.lit(False)) if "content_type" in docs.columns else F.lit(False)
    tabs = F.coalesce(F.lower("source_ref").endswith(".tsv"), F.lit(False)) | told
    each = docs.select("source_ref", F.explode(rows(F.col("content"), tabs)).alias("r"))
    return from_maps(each.select(F.concat("source_ref", F.lit("#row"), F.col("r.row").cast("string")).alias("source_ref"), "r.fields"), "csv")


def _decoded(files: DataFrame, kind: str) -> DataFrame:
    """source_ref and content of PDF or Excel files: their text, or the first sheet as CSV. Needs pypdf or openpyxl."""

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> str:
            if kind == "pdf":
                from pypdf import PdfReader

                return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
            from openpyxl import load_workbook

            book = load_workbook(io.BytesIO(data), read_only=True, data_only=True)
            out = io.StringIO()
            csv.writer(out).writerows([["" if c is None else str(c) for c in r] for r in book[book.sheetnames[0]].iter_rows(values_only=True)])
            return out.getvalue()

        return contents.map(one)

    return files.select("source_ref", text(F.col("content")).alias("content"))


def kind_of(path: Column, head: Column, content_type: Column | None = None) -> Column:
    """csv, tsv, json, html, text, pdf or xlsx: by the name's ending, else by the content type, else by how the content begins."""
    low, told = F.lower(path), F.lower(F.lit("") if content_type is None else F.coalesce(content_type, F.lit("")))
    named = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, ends.split())), lambda e: F.endswith(low, e)), k) for k, ends in KINDS.items()])
    kind = F.coalesce(named, *[F.when(told.contains(part), k) for part, k in MIMES.items()])
    start = F.lower(F.substring(F.ltrim(head), 1, 200))
    looks = F.when(start.startswith("<") & start.contains("html"), "html").when(start.rlike(r"^[{\[]"), "json").when(F.substring_index(head, "\n", 1).contains(","), "csv").otherwise("text")
    return F.coalesce(kind, looks)


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of rows with source_ref (a file name), content (bytes) and, if known, content_type, whatever their kinds. UTF-8, else Latin-1."""
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    told = F.col("content_type") if "content_type" in files.columns else F.lit(None).cast("string")
    known = files.select("source_ref", "content", told.alias("content_type"), text.alias("text")).withColumn("kind", kind_of(F.col("source_ref"), F.col("text"), F.col("content_type")))
    of = lambda *kinds: known.filter(F.col("kind").isin(*kinds)).select("source_ref", "content_type", F.col("text").alias("content"))
    parts = [csv_contents(of("csv", "tsv")), from_json(of("json")), from_html(of("html")), from_text(of("text"))]
    for kind, read in (("pdf", lambda d: from_text(d, source="pdf")), ("xlsx", csv_contents)):
        binary = known.filter(F.col("kind") == kind).select("source_ref", "content")
        parts.append(read(_decoded(binary, kind)))
    records, rejects = parts[0]
    for r, x in parts[1:]:
        records, rejects = records.unionByName(r), rejects.unionByName(x)
    return records, rejects


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of a folder of files of any kinds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return ingest(files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("source_ref"), "content"))


def form_attributes(text: Column) -> Column:
    """Lines of `key: value` or `key = value` as a map: a colon is tried first, comments and other lines are skipped, the last value of a key counts."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), stripped)
    part = lambda x, i: stripped(F.when(x.contains(":"), F.regexp_extract(x, r"^([^:]*):(.*)$", i)).otherwise(F.regexp_extract(x, r"^([^=]*)=(.*)$", i)))
    pair = lambda x: F.struct(part(x, 1).alias("key"), part(x, 2).alias("value"))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & x.rlike("[:=]"))
    pairs = F.filter(F.transform(kept, pair), lambda p: (p["key"] != "") & (p["value"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda e: e["key"] == p["key"]))
    return F.map_from_entries(last)


def from_form(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of rows with source_ref, name, description, category and attributes (text, as a person writes it)."""
    text = lambda c: stripped(F.coalesce(F.col(c), F.lit(""))).alias(c)
    rows = forms.select(F.lit("manual").alias("source"), "source_ref", text("name"), text("description"), text("category"), F.lit("").alias("sku"), form_attributes(F.col("attributes")).alias("attributes"))
    return rows.filter("name <> ''"), rows.filter("name = ''").select("source_ref", F.lit("no name").alias("reason"))
