"""What a Parquet file tells without its data pages: exact nulls and extrema from the footer, and
the distinct candidates of a column chunk from its dictionary page."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq

#: Fixed values of the Parquet format: page types and encodings.
DATA_PAGE, DICTIONARY_PAGE, DATA_PAGE_V2 = 0, 2, 3
DICTIONARY_ENCODINGS = (2, 8)
_HEADER_BYTES = 1 << 16


def open_file(path: str) -> BinaryIO:
    """A seekable file by path or URI, local or of any file system that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return pa.OSFile(path)


@dataclass
class ChunkStats:
    """Statistics of one column chunk. nulls, low and high are None where the footer does not
    have them or they are not exact."""

    column: str
    row_group: int
    rows: int
    nulls: int | None
    low: Any
    high: Any


def column_bytes(meta: pq.FileMetaData, columns: list[str]) -> list[int]:
    """Compressed bytes of the named columns in each row group of a file."""
    at = [i for i in range(meta.num_columns) if meta.schema.column(i).path in columns]
    return [sum(meta.row_group(g).column(i).total_compressed_size for i in at) for g in range(meta.num_row_groups)]


def footer_stats(meta: pq.FileMetaData, columns: list[str], groups: list[int] | None = None) -> list[ChunkStats]:
    """ChunkStats of the named columns in the named row groups of a file, else in all."""
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    out = []
    for group in range(meta.num_row_groups) if groups is None else groups:
        rows = meta.row_group(group)
        for column in columns:
            if column not in at:
                continue
            stats = rows.column(at[column]).statistics
            nulls = stats.null_count if stats is not None and stats.has_null_count else None
            exact = stats is not None and stats.has_min_max
            for flag in ("is_min_value_exact", "is_max_value_exact"):
                exact = exact and getattr(stats, flag, None) is not False
            out.append(ChunkStats(column, group, rows.num_rows, nulls, stats.min if exact else None, stats.max if exact else None))
    return out


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _thrift(data: bytes, at: int) -> tuple[dict, int]:
    """A struct of the compact Thrift protocol as {field id: value}, and where it ends."""
    out: dict[int, Any] = {}
    number = 0
    while True:
        head = data[at]
        at += 1
        if head == 0:
            return out, at
        kind = head & 15
        if head >> 4:
            number += head >> 4
        else:
            number, at = _varint(data, at)
            number = (number >> 1) ^ -(number & 1)
        out[number], at = _thrift_value(data, at, kind)


def _thrift_value(data: bytes, at: int, kind: int) -> tuple[Any, int]:
    if kind in (1, 2):
        return kind == 1, at
    if kind == 3:
        return data[at], at + 1
    if kind in (4, 5, 6):
        value, at = _varint(data, at)
        return (value >> 1) ^ -(value & 1), at
    if kind == 7:
        return struct.unpack_from("<d", data, at)[0], at + 8
    if kind == 8:
        size, at = _varint(data, at)
        return data[at : at + size], at + size
    if kind in (9, 10):
        size, inner = data[at] >> 4, data[at] & 15
        at += 1
        if size == 15:
            size, at = _varint(data, at)
        values = []
        for _ in range(size):
            value, at = (data[at] == 1, at + 1) if inner in (1, 2) else _thrift_value(data, at, inner)
            values.append(value)
        return values, at
    if kind == 12:
        return _thrift(data, at)
    raise ValueError(f"thrift type {kind}")


def dictionary_values(source: BinaryIO, meta: pq.FileMetaData, row_group: int, column: str) -> list[str] | None:
    """The dictionary of a string column chunk, in whose data pages all values are dictionary
    indexes; None where a data page holds values itself or the chunk has no dictionary.

    Reads page headers and the dictionary page, no data page.
    """
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    chunk = meta.row_group(row_group).column(at[column])
    if not chunk.has_dictionary_page or chunk.dictionary_page_offset is None or chunk.physical_type != "BYTE_ARRAY":
        return None
    start = min(chunk.dictionary_page_offset, chunk.data_page_offset)
    end = start + chunk.total_compressed_size
    values = None
    while start < end:
        source.seek(start)
        try:
            header, size = _thrift(source.read(min(_HEADER_BYTES, end - start)), 0)
        except (IndexError, ValueError):
            return None
        if header[1] == DICTIONARY_PAGE:
            source.seek(start + size)
            data = source.read(header[3])
            if chunk.compression != "UNCOMPRESSED":
                data = pa.Codec(chunk.compression.lower()).decompress(data, header[2]).to_pybytes()
            values, place = [], 0
            for _ in range(header[7][1]):
                (length,) = struct.unpack_from("<I", data, place)
                values.append(data[place + 4 : place + 4 + length].decode("utf-8", "replace"))
                place += 4 + length
        else:
            encoding = header[5][2] if header[1] == DATA_PAGE else header[8][4] if header[1] == DATA_PAGE_V2 else None
            if encoding not in DICTIONARY_ENCODINGS:
                return None
        start += size + header[3]
    return values
