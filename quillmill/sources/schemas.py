"""Fixed schemas of page primitives, canonical blocks and jobs; nothing is inferred on reading."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import types as Y

PAGES = "doc_id BIGINT, page INT, width DOUBLE, height DOUBLE, rotation INT"
SPANS = "doc_id BIGINT, page INT, block_no INT, line_no INT, span_no INT, text STRING, font STRING, size DOUBLE, flags INT, color INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
IMAGES = "doc_id BIGINT, page INT, idx INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, width INT, height INT, xref INT, media_type STRING, content BINARY"
RULES = "doc_id BIGINT, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
BLOCKS = "doc_id BIGINT, block_id STRING, parent_id STRING, depth INT, ord INT, type STRING, page INT, lang STRING, script STRING, dir STRING, confidence DOUBLE, warnings ARRAY<STRING>, modified BOOLEAN, level INT, text STRING, source_text STRING, transformations ARRAY<STRING>, resource_id STRING"
RESOURCES = "doc_id BIGINT, resource_id STRING, kind STRING, media_type STRING, filename STRING, source_page INT, content BINARY"
OCR_WORDS = "doc_id BIGINT, page INT, word_no INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, conf DOUBLE, block_num INT, par_num INT, line_num INT"
JOBS = "job_id STRING, document_id STRING, status STRING, stage STRING, progress INT, error STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
TABLES = {"pages": PAGES, "spans": SPANS, "images": IMAGES, "rules": RULES, "blocks": BLOCKS, "resources": RESOURCES, "ocr_words": OCR_WORDS, "jobs": JOBS}


_PLAIN = {Y.LongType: "integer", Y.IntegerType: "integer", Y.DoubleType: "number", Y.StringType: "string", Y.BooleanType: "boolean"}


def _type(kind: Y.DataType) -> dict:
    if isinstance(kind, Y.ArrayType):
        return {"type": ["array", "null"], "items": _type(kind.elementType)}
    if isinstance(kind, Y.TimestampType):
        return {"type": ["string", "null"], "format": "date-time"}
    if isinstance(kind, Y.BinaryType):
        return {"type": ["string", "null"], "contentEncoding": "base64"}
    return {"type": [_PLAIN[type(kind)], "null"]}


def json_schema() -> dict:
    """JSON Schema of a row of each table, as Spark writes it as JSON; needs an active session."""
    rows = {name: {"type": "object", "properties": {f.name: _type(f.dataType) for f in Y.StructType.fromDDL(ddl)}, "additionalProperties": False} for name, ddl in TABLES.items()}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": rows}


def export_schema(path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(json_schema(), indent=2) + "\n", "utf-8")
    return path


def schema_is_current(path: str | Path) -> bool:
    """Whether the file holds the schema as it is now."""
    path = Path(path)
    return path.exists() and json.loads(path.read_text("utf-8")) == json_schema()
