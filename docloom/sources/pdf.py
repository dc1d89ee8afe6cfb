"""Text of PDF pages by the standard library: objects, Flate streams, object streams, text operators and ToUnicode maps.

What it leaves to a plugged-in reader: encrypted files, and fonts that neither are Latin nor map their codes to Unicode.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def stream_of(body: bytes) -> bytes:
    """An object's stream, decompressed; empty without one."""
    found = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not found:
        return b""
    if b"/FlateDecode" in body[: found.start()]:
        return zlib.decompressobj().decompress(found[1])
    return found[1]


def objects(data: bytes) -> dict[int, bytes]:
    """Bodies of all objects by number, those of object streams among them; a later one replaces an earlier."""
    found = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            inner, first = stream_of(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = [int(x) for x in inner[:first].split()]
            places = numbers[1::2] + [len(inner) - first]
            for number, a, b in zip(numbers[::2], places, places[1:]):
                found.setdefault(number, inner[first + a : first + b])
    return found


def entry(body: bytes, name: bytes) -> list[int]:
    """Numbers of the objects that an entry refers to, one or an array."""
    m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(n) for n in REFERENCE.findall(m[1])] if m else []


def page_numbers(found: dict[int, bytes]) -> list[int]:
    """Objects that are pages, in reading order."""
    roots = [n for n, b in found.items() if re.search(rb"/Type\s*/Pages\b", b) and not entry(b, b"Parent")]
    out: list[int] = []
    todo = sorted(roots, reverse=True)
    seen: set[int] = set()
    while todo:
        n = todo.pop()
        if n in seen or n not in found:
            continue
        seen.add(n)
        kids = entry(found[n], b"Kids")
        todo += reversed(kids)
        if re.search(rb"/Type\s*/Page\b(?!s)", found[n]):
            out.append(n)
    return out or sorted(n for n, b in found.items() if re.search(rb"/Type\s*/Page\b(?!s)", b))


def unicode_map(cmap: bytes) -> dict[int, str]:
    """Codes and texts of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(c)
            out |= {int(a, 16) + i: first[:-1] + chr(ord(first[-1]) + i) for i in range(int(b, 16) - int(a, 16) + 1) if first}
    return out


def fonts_of(found: dict[int, bytes], page: bytes) -> dict[bytes, dict[int, str]]:
    """Maps of the page's fonts that have one, by the name that text operators use."""
    body = page + b"".join(found.get(n, b"") for n in entry(page, b"Resources"))
    m = re.search(rb"/Font\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", body, re.S)
    listed = (m[1] if m[1] is not None else found.get(int(m[2]), b"")) if m else b""
    return {name: unicode_map(stream_of(found.get(to[0], b""))) for name, n in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", listed) if (to := entry(found.get(int(n), b""), b"ToUnicode"))}


def decoded(token: bytes, font: dict[int, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([nrtbf])|\\([0-7]{1,3})|\\\r?\n|\\(.)", lambda m: ESCAPES[m[1]] if m[1] else bytes([int(m[2], 8) & 255]) if m[2] else m[3] or b"", token[1:-1], flags=re.S)
    if font:
        width = 2 if max(font) > 255 or token[:1] == b"<" and len(raw) % 2 == 0 else 1
        return "".join(font.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
    return raw.decode("utf-16", "ignore") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")


def page_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """Shown strings; an operator that moves to another line ends one."""
    lines, line, operands, font = [], "", [], None
    for block in re.findall(rb"\bBT\b(.*?)\bET\b", content, re.S):
        for token in TOKEN.findall(block):
            if token[:1] in b"(<[]/+-.0123456789":
                operands.append(token)
                continue
            if token == b"Tf" and len(operands) > 1:
                font = fonts.get(operands[-2][1:])
            moved = token in (b"T*", b"'", b'"', b"Tm") or token in (b"Td", b"TD") and len(operands) > 1 and float(operands[-1]) != 0
            if moved and line:
                lines.append(line)
                line = ""
            if token in (b"Tj", b"TJ", b"'", b'"'):
                line += "".join(decoded(o, font) for o in operands if o[:1] in b"(<")
            operands = []
        if line:
            lines.append(line)
            line = ""
    return "\n".join(lines)


def pages(data: bytes) -> Iterator[str]:
    """Text of each page."""
    if b"/Encrypt" in data[-2048:]:
        raise ValueError("encrypted")
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    found = objects(data)
    for n in page_numbers(found):
        content = b"\n".join(stream_of(found.get(c, b"")) for c in entry(found[n], b"Contents"))
        yield page_text(content, fonts_of(found, found[n]))


def text(data: bytes) -> str:
    """All pages' text; as a parser for readers.parsed."""
    return "\n".join(p for p in pages(data) if p)


PAGES = T.StructType([T.StructField("page_num", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("char_count", T.IntegerType()), T.StructField("error", T.StringType())])


def page_rows(files: DataFrame, key: str = "path") -> DataFrame:
    """files: key, content. key, page_num (from 1), text, char_count and error; a file that can't be read is one row with its error."""
    shape = T.StructType([files.schema[key], *PAGES.fields])

    def run(batches):
        for batch in batches:
            keys, rows = batch.column(batch.schema.get_field_index(key)), []
            for i, data in enumerate(batch.column(batch.schema.get_field_index("content")).to_pylist()):
                try:
                    rows += [(i, n, p, len(p), None) for n, p in enumerate(pages(data or b""), 1)]
                except (ValueError, TypeError, zlib.error, IndexError) as e:  # one file's fault is that file's alone
                    rows.append((i, None, None, None, f"{type(e).__name__}: {e}"))
            column = lambda k, kind: pa.array([r[k] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([keys.take(column(0, pa.int64())), column(1, pa.int32()), column(2, pa.string()), column(3, pa.int32()), column(4, pa.string())], names=[f.name for f in shape.fields])

    return files.select(key, "content").mapInArrow(run, shape)
