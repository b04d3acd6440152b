"""Folders of files as tables: payloads checked, text decoded, delimited rows and JSON datasets read, and what is wrong reported by file and line.

Files are read by Spark's own readers, one row for each file, so any store that Spark reaches will do. A file is parsed in one task; larger
delimited files than fit one are for spark.read.csv.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters that are tried, rows in which the header is looked for, and characters that the delimiter is told from.
DELIMITERS, HEADER_ROWS, SNIFFED = ",\t;|", 5, 8192
KINDS = ("pdf", "docx", "xlsx", "html", "htm", "csv", "tsv", "txt", "json", "jsonl")


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, length and content of every file under a folder; Spark's reader passes over files without content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), "length", "content")


def decoded(content: Column) -> Column:
    """Text of UTF-8 with or without a byte order mark, else of UTF-16 that has one; null if it is neither."""
    head = F.hex(F.substring(content, 1, 3))
    plain = F.when(head == "EFBBBF", F.expr("substring(content, 4)")).otherwise(content)
    wide = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF") & (F.octet_length(content) % 2 == 0)
    return F.coalesce(F.try_validate_utf8(plain), F.when(wide, F.decode(content, "UTF-16")))


def problem(suffix: Column, content: Column) -> Column:
    """Why a payload does not fit its suffix; null if it does. Suffix and content must agree."""
    head, text = F.hex(F.substring(content, 1, 8)), decoded(content)
    start = F.lower(F.ltrim(F.substring(F.coalesce(text, F.lit("")), 1, 1024)))
    pdf = F.startswith(head, F.lit("255044462D")) & F.contains(F.hex(F.expr("substring(content, greatest(octet_length(content) - 1023, 1))")), F.lit("2525454F46"))
    zipped = F.startswith(head, F.lit("504B0304"))
    member = lambda name: F.contains(F.hex(content), F.lit(name.encode().hex().upper()))
    checks = {
        "pdf": (pdf, "not a PDF"), "docx": (zipped & member("word/document.xml"), "not a DOCX"), "xlsx": (zipped & member("xl/workbook.xml"), "not an XLSX"),
        "html": (start.rlike(r"^(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|body|[a-z][a-z0-9]*[ >/])"), "not HTML"), "csv": (text.isNotNull() & ~F.contains(text, F.lit("\x00")), "not text"),
    }
    same = {"htm": "html", "tsv": "csv", "txt": "csv", "json": "csv", "jsonl": "csv"}
    out = F.when(F.octet_length(content) == 0, "empty").when(~suffix.isin(*KINDS), "unknown suffix")
    for kind in KINDS:
        ok, why = checks[same.get(kind, kind)]
        out = out.when((suffix == kind) & ~F.coalesce(ok, F.lit(False)), why)
    return out


def sniffed(text: str) -> str:
    """The delimiter that most of the first lines have equally often, the commonest of these; a comma if none does."""
    lines = [line for line in text[:SNIFFED].splitlines() if line.strip()][:20]

    def score(d: str) -> tuple[int, int]:
        counts = [next(csv.reader([line], delimiter=d), []) for line in lines]
        widths = [len(c) for c in counts if len(c) > 1]
        usual = max(set(widths), key=widths.count) if widths else 0
        return widths.count(usual) if usual else 0, usual

    best = max(DELIMITERS, key=lambda d: (*score(d), -DELIMITERS.index(d)))
    return best if score(best)[0] else ","


def parsed(text: str) -> tuple[list[tuple[int, list[str], list[str]]], list[tuple[int, str]]]:
    """(line, header, cells) of the data rows and (line, why) of bad ones. The header is the first of the first rows whose cells are all
    filled, differ and hold a letter."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sniffed(text), strict=True)
    rows, bad, line = [], [], 1
    while True:
        try:
            cells = next(reader)
        except StopIteration:
            break
        except csv.Error as why:
            bad.append((line, str(why)))
            line = reader.line_num + 1
            continue
        if any(c.strip() for c in cells):
            rows.append((line, [c.strip() for c in cells]))
        line = reader.line_num + 1
    at = next((i for i, (_, c) in enumerate(rows[:HEADER_ROWS]) if len(c) > 1 and len(set(c)) == len(c) and all(re.search(r"[^\W\d_]", x) for x in c)), None)
    if at is None:
        return [], bad + ([(rows[0][0], "no header")] if rows else [])
    header, data = rows[at][1], []
    for line, cells in rows[at + 1 :]:
        if len(cells) > len(header):
            bad.append((line, f"{len(cells)} cells under {len(header)} headers"))
        else:
            data.append((line, header, cells + [""] * (len(header) - len(cells))))
    return data, bad


def delimited_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path, line, cells (header to value) and row_text of all rows of delimited files; and path, line and why of all that could not be read."""
    wrong = files.select("path", problem(F.col("suffix"), F.col("content")).alias("why")).where("why IS NOT NULL")
    right = files.where(F.col("suffix").isin("csv", "tsv", "txt") & problem(F.col("suffix"), F.col("content")).isNull()).select("path", decoded(F.col("content")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data, bad = parsed(text)
                for some in (data[i : i + 10_000] for i in range(0, len(data), 10_000)):
                    cells = pa.array([list(zip(h, c, strict=True)) for _, h, c in some], pa.map_(pa.string(), pa.string()))
                    shown = [" | ".join(f"{k}: {v}" for k, v in zip(h, c, strict=True) if v) for _, h, c in some]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([n for n, _, _ in some], pa.int64()), cells, pa.array(shown, pa.string()), pa.nulls(len(some), pa.string())], names)
                if bad:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(bad)), pa.array([n for n, _ in bad], pa.int64()), pa.nulls(len(bad), pa.map_(pa.string(), pa.string())), pa.nulls(len(bad), pa.string()), pa.array([w for _, w in bad], pa.string())], names)

    names = ["path", "line", "cells", "row_text", "why"]
    read = right.mapInArrow(run, "path string, line long, cells map<string,string>, row_text string, why string")
    return read.where("why IS NULL").drop("why"), read.where("why IS NOT NULL").select("path", "line", "why").unionByName(wrong.select("path", F.lit(None).cast("long").alias("line"), "why"))


def json_records(files: DataFrame, fields: dict[str, str], required: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON files (a list, or an object with a list under "records" or "cases") and JSON lines: path, line (of a list: the place) and the fields
    by their SQL types; and path, line and why of records that are no objects, lack a required field, hold unknown ones, have a value of another
    type, or repeat a key that an earlier record of the same file has."""
    wrong = files.select("path", problem(F.col("suffix"), F.col("content")).alias("why")).where("why IS NOT NULL")
    right = files.where(F.col("suffix").isin("json", "jsonl") & problem(F.col("suffix"), F.col("content")).isNull()).select("path", "suffix", decoded(F.col("content")).alias("text"))

    def records(suffix: str, text: str) -> Iterator[tuple[int, object, str | None]]:
        if suffix == "jsonl":
            for n, line in enumerate(text.split("\n"), 1):
                if line.strip():
                    try:
                        yield n, json.loads(line), None
                    except ValueError as why:
                        yield n, None, f"no JSON: {why}"
            return
        try:
            whole = json.loads(text)
        except ValueError as why:
            yield 1, None, f"no JSON: {why}"
            return
        some = whole if isinstance(whole, list) else next((whole[k] for k in ("records", "cases") if isinstance(whole, dict) and isinstance(whole.get(k), list)), None)
        if some is None:
            yield 1, None, "no list of records"
        yield from ((n, x, None) for n, x in enumerate(some or (), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, suffix, text in zip(*(batch[c].to_pylist() for c in ("path", "suffix", "text")), strict=True):
                out, seen = [], set()
                for n, x, why in records(suffix, text):
                    if why is None and not isinstance(x, dict):
                        why = "no object"
                    elif why is None:
                        unknown, missing = sorted(set(x) - set(fields)), [f for f in required if x.get(f) in (None, "", [])]
                        name = json.dumps(x.get(key))
                        why = f"unknown: {', '.join(unknown)}" if unknown else f"missing: {', '.join(missing)}" if missing else f"repeated {key}" if name in seen else None
                        seen.add(name)
                    out.append((n, json.dumps(x) if why is None else None, why))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array([n for n, _, _ in out], pa.int64()), pa.array([x for _, x, _ in out], pa.string()), pa.array([w for _, _, w in out], pa.string())], ["path", "line", "record", "why"])

    read = right.mapInArrow(run, "path string, line long, record string, why string")
    schema = ", ".join(f"`{k}` {v}" for k, v in fields.items())
    # a value that is there but cannot be of its type reads as null
    raw = F.from_json("record", "map<string,string>")
    typed = read.withColumn("r", F.from_json("record", schema)).withColumn("raw", raw)
    other = F.array_compact(F.array(*(F.when(F.col(f"r.`{k}`").isNull() & F.col("raw").getItem(k).isNotNull(), F.lit(k)) for k in fields)))
    full = typed.withColumn("why", F.coalesce("why", F.when(F.size(other) > 0, F.concat(F.lit("other type: "), F.array_join(other, ", ")))))
    bad = full.where("why IS NOT NULL").select("path", "line", "why").unionByName(wrong.select("path", F.lit(None).cast("long").alias("line"), "why"))
    return full.where("why IS NULL").select("path", "line", "r.*"), bad
