"""Text of simple PDF files: content streams, plain or deflated, with the usual operators that show strings.

Enough for files whose strings are in a one-byte encoding close to Latin-1. Fonts with encodings of their own, encryption
and object streams need a package; ``readers`` takes one if it is there.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
CONTENTS = re.compile(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)")
KIDS = re.compile(rb"/Kids\s*\[([^\]]*)\]")
# A string, an array's end, or an operator that shows text or begins a line.
TOKEN = re.compile(
    rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\bT[jJdDm*]|\bET\b|[\"']|[-+]?\d*\.?\d+|[A-Za-z*]+|[\[\]]", re.DOTALL
)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def unescaped(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        if m[1] is not None:
            return bytes([int(m[1], 8) & 255])
        return ESCAPES.get(m[2], m[2])

    return re.sub(rb"\\(?:([0-7]{1,3})|(.))", one, raw, flags=re.DOTALL).decode("latin-1")


def string_of(token: bytes) -> str:
    if token.startswith(b"("):
        return unescaped(token[1:-1])
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")


def shown(content: bytes) -> str:
    """The strings a content stream shows, with a line break where the text position moves to another line."""
    lines, held, moves = [[]], [], []
    for token in TOKEN.findall(content):
        if token[:1] in (b"(", b"<"):
            held.append(string_of(token))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            moves.append(float(token))
        elif token in (b"[", b"]"):
            continue
        else:
            if token in (b"T*", b"'", b'"', b"Tm", b"ET") or (token in (b"Td", b"TD") and moves[-1:] not in ([], [0.0])):
                lines.append([])
            if token in (b"Tj", b"TJ", b"'", b'"'):
                lines[-1] += held
            held, moves = [], []
    return "\n".join(filter(None, ("".join(line).strip() for line in lines)))


def pdf_text(data: bytes) -> str:
    """The text of all pages in their order, joined by line breaks."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in data:
        raise ValueError("encrypted PDF")
    objects = {int(m[1]): m[2] for m in OBJECT.finditer(data)}

    def content(number: int) -> bytes:
        body = objects.get(number, b"")
        found = STREAM.search(body)
        if not found:
            return b""
        if b"/FlateDecode" not in body[: found.start()]:
            return found[1]
        return zlib.decompressobj().decompress(found[1])

    def pages(number: int, seen: frozenset[int]) -> list[int]:
        kids = KIDS.search(objects.get(number, b""))
        if not kids or number in seen:
            return [number]
        return [p for k in REFERENCE.findall(kids[1]) for p in pages(int(k), seen | {number})]

    roots = [n for n, body in objects.items() if re.search(rb"/Type\s*/Pages\b", body) and not re.search(rb"/Parent\b", body)]
    texts = []
    for page in [p for root in roots for p in pages(root, frozenset())]:
        where = CONTENTS.search(objects.get(page, b""))
        if where:
            texts.append(shown(b"\n".join(content(int(n)) for n in REFERENCE.findall(where[1]))))
    return "\n".join(filter(None, texts))
