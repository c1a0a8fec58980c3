"""The built-in reader of PDF pages, for files whose text is in a plain one-byte encoding.

It follows the page tree, inflates content streams (also of objects that are packed in object streams) and takes the
strings that text operators show; moves to another line become line ends. Encrypted files, other filters than Flate and
fonts with encodings of their own are beyond it: a PDF library's reader can be given to readers.paper_texts() instead.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TEXT = re.compile(rb"BT\b(.*?)\bET\b", re.DOTALL)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[A-Za-z'\"*]+|[-+]?[\d.]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    head = body[: found.start()]
    if b"/Filter" not in head:
        return found[1]
    if b"/FlateDecode" not in head or re.search(rb"/(LZW|ASCII85|ASCIIHex|DCT|RunLength)Decode", head):
        raise ValueError("a content stream has a filter that this reader does not know")
    return zlib.decompressobj().decompress(found[1])


def _objects(content: bytes) -> dict[int, bytes]:
    if b"/Encrypt" in content:
        raise ValueError("the file is encrypted")
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            first, data = int(re.search(rb"/First\s+(\d+)", body)[1]), _inflated(body)
            table = [int(x) for x in data[:first].split()]
            places = [*table[1::2], len(data) - first]
            for number, a, b in zip(table[::2], places, places[1:], strict=False):
                found.setdefault(number, data[first + a : first + b])
    return found


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _shown(stream: bytes) -> str:
    out: list[str] = []
    for part in _TEXT.finditer(stream):
        held: list[bytes] = []
        for token in _TOKEN.findall(part[1]):
            if token[:1] in b"(<":
                held.append(_string(token).encode())
            elif re.fullmatch(rb"-\d{3,}[\d.]*", token):
                held += [b" "] if held else []  # a wide gap within an array of strings
            elif re.fullmatch(rb"[-+]?[\d.]+", token):
                continue
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                out += ["\n"] if token in (b"'", b'"') and out else []
                out.append(b"".join(held).decode())
                held = []
            elif token in (b"Td", b"TD", b"T*", b"Tm"):
                out += ["\n"] if out and out[-1] != "\n" else []
                held = []
            elif token not in (b"[", b"]"):
                held = []
        out += ["\n"] if out and out[-1] != "\n" else []
    return "".join(out)


def pages(content: bytes) -> list[str]:
    """The text of each page, in the order of the page tree. Bytes that are not a PDF, or have no pages, are an error."""
    if b"%PDF-" not in content[:1024]:
        raise ValueError("not a PDF")
    objects = _objects(content)
    tree = next((b for b in objects.values() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b), None)
    if tree is None:
        raise ValueError("no page tree")
    found: list[str] = []

    def walk(body: bytes, depth: int) -> None:
        if depth > 50:
            raise ValueError("the page tree is too deep")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL)
        if kids:
            for number in _REF.findall(kids[1]):
                walk(objects[int(number)], depth + 1)
            return
        listed = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.DOTALL)
        found.append("".join(_shown(_inflated(objects[int(n)])) for n in _REF.findall(listed[1])) if listed else "")

    walk(tree, 0)
    return found
