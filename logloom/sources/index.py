"""The binary index of a table's rows and lookups, for interchange: a magic, then little-endian numbers and strings
with their lengths. Its text predecessor can be read. The engine itself has Parquet snapshots in its place."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from .. import errors as E

# Fixed values of the format.
MAGIC, TEXT_MAGIC, VERSION = b"SIXB\0", "SIXB", 2
ESCAPES = {"\\\\": "\\", "\\t": "\t", "\\n": "\n", "\\r": "\r"}


@dataclass
class Index:
    table: str
    schema_hash: str
    source_hash: str
    rows: list[tuple[str, str, int, int, int]] = field(default_factory=list)  # id, chunk, offset, length, tx
    lookups: list[tuple[str, str, str]] = field(default_factory=list)  # field, key, id
    version: int = VERSION

    def is_current(self, table: str, schema_hash: str, source_hash: str) -> bool:
        return (self.version, self.table, self.schema_hash, self.source_hash) == (VERSION, table, schema_hash, source_hash)


def encode_index(index: Index) -> bytes:
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    out = [MAGIC, struct.pack("<I", VERSION), *map(text, (index.table, index.schema_hash, index.source_hash)), struct.pack("<I", len(index.rows))]
    for row_id, chunk, *place in index.rows:
        out += [text(row_id), text(chunk), struct.pack("<QIQ", *place)]
    out.append(struct.pack("<I", len(index.lookups)))
    out += [text(s) for entry in index.lookups for s in entry]
    return b"".join(out)


def decode_index(data: bytes) -> Index:
    return _binary(data) if data.startswith(MAGIC) else _text(data)


def _binary(data: bytes) -> Index:
    at = len(MAGIC)

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise E.BadIndex("the data end too early")
        at += size
        return struct.unpack_from(form, data, at - size)

    def string() -> str:
        (size,) = take("<I")
        (raw,) = take(f"{size}s")
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise E.BadIndex(f"invalid utf-8: {e}") from None

    (version,) = take("<I")
    index = Index(string(), string(), string(), version=version)
    for _ in range(take("<I")[0]):
        index.rows.append((string(), string(), *take("<QIQ")))
    for _ in range(take("<I")[0]):
        index.lookups.append((string(), string(), string()))
    if at != len(data):
        raise E.BadIndex("bytes are left at the end")
    return index


def _plain(text: str) -> str:
    if re.sub(r"\\[\\tnr]", "", text).count("\\"):
        raise E.BadEscape(text)
    return re.sub(r"\\[\\tnr]", lambda m: ESCAPES[m[0]], text)


def _text(data: bytes) -> Index:
    try:
        head, *lines = data.decode().splitlines() or [""]
    except UnicodeDecodeError as e:
        raise E.BadIndex(f"invalid utf-8: {e}") from None
    parts = head.split("\t")
    if len(parts) != 5 or parts[0] != TEXT_MAGIC:
        raise E.BadIndex("bad SIXB header")
    number = lambda s, most: int(s) if re.fullmatch(r"\+?[0-9]+", s) and int(s) < most else None
    if (version := number(parts[1], 2**32)) is None:
        raise E.BadIndex(f"bad version: {parts[1]}")
    index = Index(*map(_plain, parts[2:]), version=version)
    for line in filter(str.strip, lines):
        kind, *cells = line.split("\t")
        if kind == "row" and len(cells) == 5:
            place = [number(c, most) for c, most in zip(cells[2:], (2**64, 2**32, 2**64))]
            if None in place:
                raise E.BadIndex(f"bad entry: {line}")
            index.rows.append((_plain(cells[0]), _plain(cells[1]), *place))
        elif kind == "lookup" and len(cells) == 3:
            index.lookups.append(tuple(map(_plain, cells)))
        else:
            raise E.BadIndex(f"bad entry: {line}")
    return index
