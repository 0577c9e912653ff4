"""Outline notes (org files): front matter, headings, and two tiers of chunks.

A file is cut inside its row: nothing is shuffled.  Front matter and the embedded text
are SQL functions; sections and pieces need a stack and running sums and are found in
Arrow batches (outline.py), in time linear in the chunks.  A section
holds the text of the sections below it; an archived heading gives no chunks of its
own but stays in its parent's text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodeframe.functions.text import SPACE, bind, enriched, trim_all, utf16_length
from lodeframe.operators import outline
from lodeframe.schema import FOLDER_LIMITS
from lodeframe.sources.files import note_folder
from lodeframe.sources.spread import spread

MIN_FILE, MIN_HEADING, MIN_CONTENT = 50, 20, 30
#: Chunks that a task holds at once: rows, and characters of their texts and hierarchies.
BATCH_ROWS, BATCH_CHARS = 2_000, 8_000_000


def _parts(text: Column, by: str) -> Column:
    return F.filter(F.split(text, by), lambda x: x != "")


def parse_name(path: Column) -> Column:
    """struct<identifier, title, filetags> of a file name `id--title__tag_tag.org`; empty if it is none."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.org$", "")
    # fixed value: the pattern of note names
    pattern = r"^(\d{8}T\d{6})--(.+?)(?:__(.+))?$"
    return bind(
        name,
        lambda n: F.struct(
            F.regexp_extract(n, pattern, 1).alias("identifier"), F.regexp_extract(n, pattern, 2).alias("title"), _parts(F.regexp_extract(n, pattern, 3), "_").alias("filetags")
        ),
    )


def front_matter(content: Column, path: Column) -> Column:
    """struct<identifier, title, filetags, date, folder, references, titlePrefix, hasGptelProps>.

    Only what stands before the first heading counts (or the first 2,000 characters).
    A key without a value takes the next line.
    """
    at = F.instr(content, F.lit("\n*"))

    def value(header, key):
        return trim_all(F.regexp_extract(header, rf"(?mi)^#\+{key}:{SPACE}*(.+)$", 1))

    def build(x):
        header, name = x["header"], x["name"]
        own = lambda key, other: bind(value(header, key), lambda v: F.when(v != "", v).otherwise(other))
        tags, refs = value(header, "filetags"), value(header, "reference")
        return bind(
            own("title", name["title"]),
            lambda title: F.struct(
                own("identifier", name["identifier"]).alias("identifier"),
                title.alias("title"),
                bind(tags, lambda t: F.when(t != "", _parts(t, ":")).otherwise(name["filetags"])).alias("filetags"),
                value(header, "date").alias("date"),
                note_folder(path).alias("folder"),
                F.filter(F.transform(F.split(refs, ";"), trim_all), lambda r: r != "").alias("references"),
                F.regexp_extract(title, "^([§†‡@#])", 1).alias("titlePrefix"),
                F.regexp(header, F.lit("(?m)^:GPTEL_(MODEL|BACKEND):")).alias("hasGptelProps"),
            ),
        )

    header = F.when(at > 1, F.substring(content, F.lit(1), at - 1)).otherwise(F.left(content, F.lit(2000)))
    return bind(F.struct(header.alias("header"), parse_name(path).alias("name")), build)


@F.arrow_udf(ArrayType(StructType([StructField("text", StringType()), StructField("offsetLines", IntegerType())])))
def sub_chunks(text: pa.Array, most: pa.Array, overlap: pa.Array) -> pa.Array:
    """array<struct<text, offsetLines>>: greedy packing of lines, see outline.pack(); null for a null text."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("offsetLines", pa.int32())]))
    rows = zip(text.to_pylist(), most.to_pylist(), overlap.to_pylist())
    return pa.array([None if t is None else [{"text": piece, "offsetLines": at} for piece, at, _ in outline.pack(t, m, o)] for t, m, o in rows], kind)


def _limits(folder: Column, which: int) -> Column:
    table = F.create_map(*[F.lit(v) for k, pair in FOLDER_LIMITS.items() for v in (k, pair[which])])
    return F.coalesce(F.try_element_at(table, folder), F.lit(FOLDER_LIMITS["default"][which]))


_HEADING = "level int, title string, tags array<string>, lineNumber int, properties map<string,string>, isArchive boolean, isLlmlog boolean"
_HEADING_TYPE = pa.struct(
    [("level", pa.int32()), ("title", pa.string()), ("tags", pa.list_(pa.string())), ("lineNumber", pa.int32()), ("properties", pa.map_(pa.string(), pa.string())), ("isArchive", pa.bool_()), ("isLlmlog", pa.bool_())]
)


def _heading(h: outline.Heading) -> dict:
    return h._asdict() | {"properties": list(h.properties.items())}


def _dealt(batches: Iterator[pa.RecordBatch], each: Callable, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows (path, metadata, content, ...) to those that each(content, ...) yields, with their path and metadata.

    What is yielded at once is bounded by its rows and by the last value of each, its size.
    """
    for batch in batches:
        at, out, size = [], [], 0

        def ready():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *columns], ["path", "metadata", *names])

        for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
            for values in each(*row):
                at.append(i)
                out.append(values[:-1])
                size += values[-1]
                if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield ready()
                    at, out, size = [], [], 0
        if out:
            yield ready()


def note_headings(files: DataFrame) -> DataFrame:
    """path, heading fields, hierarchy and sectionEnd of every heading of files (path, content).

    sectionEnd is the number of lines up to the next heading of the same or a lower level.
    """

    def each(content):
        lines = content.split("\n")
        found = outline.find_headings(lines)
        for h, above, end in zip(found, outline.hierarchies(found), outline.section_ends(found, len(lines))):
            yield _heading(h), above, end, len(above)

    def run(batches):
        yield from _dealt(batches, each, ["h", "hierarchy", "sectionEnd"], [_HEADING_TYPE, pa.string(), pa.int32()])

    base = spread(files.filter("content IS NOT NULL").select("path", F.lit(0).alias("metadata"), "content"))
    rows = base.mapInArrow(run, f"path string, metadata int, h struct<{_HEADING}>, hierarchy string, sectionEnd int")
    return rows.select("path", "h.*", "hierarchy", "sectionEnd")


def note_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content): one per heading, and the text of each section in pieces.

    id, text, rawText, path, folder, lineNumber, endLineNumber, chunkType, metadata, hierarchy, heading.
    """

    def pieces(content, of, above, line, first, most, overlap):
        if outline.utf16_size(content) >= MIN_CONTENT:
            for j, (raw, at, n) in enumerate(outline.pack(content, most, overlap)):
                yield of, above, "content", j, raw, line + at + first, line + at + n, len(raw) + len(above)

    def each(content, most, overlap):
        lines = content.split("\n")
        found = outline.find_headings(lines)
        if not found:
            yield from pieces(outline.content_of(lines, 0, len(lines)), None, "", 0, 1, most, overlap)
        for h, above, end in zip(found, outline.hierarchies(found), outline.section_ends(found, len(lines))):
            if not h.isArchive:
                of = _heading(h)
                yield of, above, "heading", 0, h.title, h.lineNumber, h.lineNumber, len(above)
                yield from pieces(outline.content_of(lines, h.lineNumber, end), of, above, h.lineNumber, 0, most, overlap)

    def run(batches):
        names, types = ["heading", "hierarchy", "chunkType", "j", "rawText", "lineNumber", "endLineNumber"], [_HEADING_TYPE, pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        yield from _dealt(batches, each, names, types)

    base = spread(files.filter(utf16_length(F.col("content")) >= MIN_FILE).select("path", "content"))
    base = base.select("path", front_matter(F.col("content"), F.col("path")).alias("metadata"), "content")
    base = base.select("path", "metadata", "content", _limits(F.col("metadata.folder"), 0).alias("most"), _limits(F.col("metadata.folder"), 1).alias("overlap"))
    kind = base.schema["metadata"].dataType.simpleString()
    rows = base.mapInArrow(run, f"path string, metadata {kind}, heading struct<{_HEADING}>, hierarchy string, chunkType string, j int, rawText string, lineNumber int, endLineNumber int")
    meta, is_heading = F.col("metadata"), F.col("chunkType") == "heading"
    tags = F.coalesce("heading.tags", F.array().cast("array<string>"))
    text = enriched(meta["title"], meta["filetags"], F.col("hierarchy"), tags, F.coalesce("heading.isArchive", F.lit(False)), F.when(is_heading, "").otherwise(F.col("rawText")))
    own = F.when(is_heading, F.concat(F.lit("h"), F.col("heading.lineNumber"))).otherwise(F.concat(F.lit("c"), F.concat_ws(":", "heading.lineNumber", "j")))
    rows = rows.withColumns({"text": text, "id": F.concat_ws(":", "path", own)}).filter(~is_heading | (utf16_length(F.col("text")) >= MIN_HEADING))
    return rows.select("id", "text", "rawText", "path", F.col("metadata.folder").alias("folder"), "lineNumber", "endLineNumber", "chunkType", "metadata", "hierarchy", "heading")


def as_chunks(notes: DataFrame) -> DataFrame:
    """note_chunks() in the columns of the chunk table; the timestamp is the date, else the identifier."""
    meta = F.col("metadata")
    return notes.select(
        "id",
        "text",
        F.col("path").alias("sessionFile"),
        F.col("folder").alias("project"),
        "lineNumber",
        F.when(meta["date"] != "", meta["date"]).otherwise(meta["identifier"]).alias("timestamp"),
        F.col("chunkType").alias("role"),
        F.lit("").alias("source"),
        F.create_map(
            F.lit("title"), meta["title"], F.lit("tags"), F.array_join(meta["filetags"], ","), F.lit("hierarchy"), F.col("hierarchy"),
            F.lit("prefix"), meta["titlePrefix"], F.lit("identifier"), meta["identifier"],
        ).alias("metadata"),
    )
