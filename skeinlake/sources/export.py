"""Chat exports: a strict JSON array of conversation objects, split, parsed and brought to one form.

Files are read with Spark's binary reader, one row a file, so a folder of exports
spreads over tasks and any store that Spark reads will do. A single array can't
be split, so its file is one task; the rows are dealt out before they are
scanned. Errors that end a run come back as a row with run_error instead of an
exception, so the driver can report the first one in file order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P

JS_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_STRUCTURE = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]]|"', re.S)
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]]|[,:]|[^\s{}\[\],:"]+|\s+|"', re.S)


class InputError(Exception):
    """An error that ends a run; code is part of the interface. at: the byte of the input where it was found, if known."""

    def __init__(self, code: str, message: str = "", at: int | None = None):
        super().__init__(message or code)
        self.code, self.at = code, at


def _skip(data: bytes, at: int) -> int:
    while at < len(data):
        if data[at] in b"\t\n\x0b\x0c\r ":
            at += 1
            continue
        if data[at] < 0x80:
            break
        size = 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        if data[at : at + size].decode("utf-8") not in JS_SPACE:
            break
        at += size
    return at


def split(content: bytes) -> Iterator[tuple[int, str]]:
    """index and text of each object of the array; InputError where the input isn't one, or an item passes a limit."""
    data = content.removeprefix(b"\xef\xbb\xbf")
    try:
        data.decode("utf-8")
        broken = len(data) + 1
    except UnicodeDecodeError as e:
        broken = e.start  # what is wrong before this byte is told first
    places = _places(data)
    index = 0
    while True:
        try:
            start, end = next(places)
        except StopIteration:
            break
        except UnicodeDecodeError:
            raise InputError("INVALID_UTF8") from None
        except InputError as e:
            if broken <= len(data) and (e.at is None or e.at >= broken):
                raise InputError("INVALID_UTF8") from None
            raise
        if end > broken:
            break
        yield index, data[start:end].decode("utf-8")
        index += 1
    if broken <= len(data):
        raise InputError("INVALID_UTF8")


def _places(data: bytes) -> Iterator[tuple[int, int]]:
    """Where each object of the array begins and ends."""
    bad = lambda at: InputError("INVALID_JSON_ARRAY", f"offset {len(data[:at].decode('utf-8', 'ignore'))}", at)
    at = _skip(data, 0)
    if data[at : at + 1] != b"[":
        raise bad(at)
    at, comma = at + 1, False
    while True:
        at = _skip(data, at)
        c = data[at : at + 1]
        if c == b"]" and not comma:
            break
        if c != b"{":
            raise bad(at)
        end = _item(data, at)
        yield at, end
        at = _skip(data, end)
        c = data[at : at + 1]
        if c == b"]":
            break
        if c != b",":
            raise bad(at)
        at, comma = at + 1, True
    if _skip(data, at + 1) != len(data):
        raise bad(at + 1)


def _item(data: bytes, start: int) -> int:
    """End of the object that begins at start. An item has no more tokens than bytes, so they are counted only if it is long."""
    depth = 0
    for m in _STRUCTURE.finditer(data, start):
        first = data[m.start()]
        if m.end() - start > P.MAX_TOKENS or depth > P.MAX_DEPTH or (first == 34 and m.end() - m.start() == 1):
            break
        if first in b"{[":
            depth += 1
        elif first in b"}]":
            depth -= 1
            if not depth:
                return m.end()
    return _long_item(data, start)


def _long_item(data: bytes, start: int) -> int:
    """The same, token by token, with all limits. Brackets are counted, not matched: a wrong one is the parser's to find."""
    depth = tokens = 0
    for m in _TOKEN.finditer(data, start):
        if m.end() - start > P.MAX_ITEM_BYTES:
            raise InputError("CONVERSATION_TOO_LARGE")
        first = data[m.start()]
        if first in b'"{[,:' or (first not in b"}]" and not m.group().isspace()):
            tokens += 1
            if tokens > P.MAX_TOKENS:
                raise InputError("INPUT_STRUCTURE_TOO_COMPLEX")
        if first in b"{[":
            depth += 1
            if depth > P.MAX_DEPTH:
                raise InputError("INPUT_STRUCTURE_TOO_COMPLEX")
        elif first in b"}]":
            depth -= 1
            if not depth:
                return m.end()
        elif m.group() == b'"':  # a string without an end
            break
    if len(data) - start > P.MAX_ITEM_BYTES:
        raise InputError("CONVERSATION_TOO_LARGE")
    raise InputError("INVALID_JSON_ARRAY", "an object isn't closed")


def _no_constant(name: str):
    raise ValueError(name)


def parse(raw: str) -> object:
    return json.loads(raw, parse_constant=_no_constant)


def js_values(record: dict) -> list:
    """Values in the order of a script object's keys: array indexes ascending, then the others as they came."""
    index = lambda k: k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1
    return [v for _, v in js_entries(record, index)]


def js_entries(record: dict, index=None) -> list[tuple[str, object]]:
    index = index or (lambda k: k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1)
    return sorted(((k, v) for k, v in record.items() if index(k)), key=lambda e: int(e[0])) + [e for e in record.items() if not index(e[0])]


def trim(s: str) -> str:
    return s.strip(JS_SPACE)


def stable_id(record: dict) -> str | None:
    for k in ("id", "conversation_id"):
        if isinstance(record.get(k), str) and trim(record[k]):
            return trim(record[k])
    return None


def is_conversation(value: object) -> bool:
    return isinstance(value, dict) and isinstance(value.get("mapping"), dict) and stable_id(value) is not None


def timestamp(value: object) -> str | None:
    """ISO time of seconds, of milliseconds from 10**10 on, or of an ISO string."""
    try:
        if isinstance(value, bool):
            return None
        if isinstance(value, (int, float)):
            at = datetime.fromtimestamp((value * 1000 if value < 10_000_000_000 else value) / 1000, UTC)
        elif isinstance(value, str) and trim(value):
            at = datetime.fromisoformat(trim(value))
            at = at.replace(tzinfo=at.tzinfo or UTC).astimezone(UTC)
        else:
            return None
    except (ValueError, OverflowError, OSError):
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def units(s: str) -> bytes:
    return s.encode("utf-16-le", "surrogatepass")


def _whole(s: str) -> str:
    """s with lone surrogates replaced, which is how they are hashed and written."""
    return units(s).decode("utf-16-le", "replace") if not s.isascii() else s


def truncated(s: str) -> tuple[str, bool]:
    """s, or its first and last half of the limit, in UTF-16 units."""
    u = units(s)
    if len(u) <= 2 * P.MAX_CHARACTERS:
        return s, False
    half = P.MAX_CHARACTERS
    cut = lambda b: b.decode("utf-16-le", "replace")
    return cut(u[:half]) + "\n[CONTENT_TRUNCATED]\n" + cut(u[-half:]), True


def _attachments(value: object) -> list[str]:
    if not isinstance(value, dict):
        return []
    return [f"attachment.{k}:{trim(v)}" for k, v in js_entries(value) if k in P.ATTACHMENT_KEYS and isinstance(v, str) and trim(v)]


def message(node: object) -> dict | None:
    """A node's message: what may be classified, and what must be scanned, as one text and by parts."""
    m = node.get("message") if isinstance(node, dict) else None
    if not isinstance(m, dict):
        return None
    content, author, meta = (m.get(k) if isinstance(m.get(k), dict) else {} for k in ("content", "author", "metadata"))
    parts = content.get("parts") if isinstance(content.get("parts"), list) else []
    texts = [p for p in parts if isinstance(p, str)]
    role = author.get("role") if isinstance(author.get("role"), str) else None
    hidden = meta.get("is_visually_hidden_from_conversation") is True or meta.get("hidden") is True
    listed = meta.get("attachments") if isinstance(meta.get("attachments"), list) else []
    named = [x for p in [*parts, *listed] for x in _attachments(p)]
    scanned = "\n".join(x for x in [trim("".join(texts)), *named] if x)
    if not scanned:
        return None
    visible = trim("\n".join(x for x in map(trim, texts) if x)) if not hidden and role in (None, "user", "assistant") else ""
    at = m.get("create_time")
    return {"shown": visible, "text": scanned, "parts": [*texts, *named] if len(texts) > 1 else [], "at": at if isinstance(at, (int, float)) and not isinstance(at, bool) else 0}


class ItemError(Exception):
    pass


def branch(mapping: dict, node_id: str) -> list | None:
    """The nodes from the root to node_id; None if one is missing."""
    out, seen = [], set()
    while True:
        if node_id in seen:
            raise ItemError("INVALID_BRANCH")
        seen.add(node_id)
        node = mapping.get(node_id)
        if not isinstance(node, dict):
            return None
        out.append(node)
        parent = node.get("parent")
        if parent is None or parent == "":
            return out[::-1]
        if not isinstance(parent, str):
            raise ItemError("INVALID_BRANCH")
        node_id = parent


def canonical(value: object) -> dict:
    """The one form of a conversation; ItemError with the code of what is wrong."""
    if not isinstance(value, dict):
        raise ItemError("INVALID_CONVERSATION")
    source = stable_id(value)
    if source is None:
        raise ItemError("MISSING_CONVERSATION_ID")
    mapping = value.get("mapping")
    if not isinstance(mapping, dict):
        raise ItemError("MISSING_MAPPING")
    if len(mapping) > P.MAX_NODES:
        raise ItemError("MAPPING_NODE_LIMIT_EXCEEDED")
    current = value.get("current_node")
    nodes = branch(mapping, current) if isinstance(current, str) and current else None
    on_branch = nodes is not None
    found = [m for m in map(message, nodes if on_branch else js_values(mapping)) if m]
    if not on_branch:
        found.sort(key=lambda m: m["at"])
    title = trim(value["title"]) if isinstance(value.get("title"), str) else ""
    title = title or P.UNTITLED
    shown = [m["shown"] for m in found if m["shown"]]
    picked = [truncated(t) for t in (shown if len(shown) <= 6 else shown[:3] + shown[-3:])]
    bounded, cut = truncated(title)
    return {
        "source_id": _whole(source), "title": _whole(title), "classification_title": _whole(bounded),
        "created_at": timestamp(value.get("create_time")), "updated_at": timestamp(value.get("update_time")),
        "message_count": len(found), "available": any(m["shown"] for m in found), "truncated": cut or any(t for _, t in picked),
        "current": on_branch, "sampled": [_whole(t) for t, _ in picked],
        "messages": [{"text": _whole(m["text"]), "parts": [_whole(p) for p in m["parts"]]} for m in found],
    }


CANONICAL = (
    "source_id string, title string, classification_title string, created_at string, updated_at string, message_count long, "
    "available boolean, truncated boolean, current boolean, sampled array<string>, messages array<struct<text:string,parts:array<string>>>"
)
ITEMS = "path string, item_index long, raw string, run_error string"


def items(spark: SparkSession, path: str) -> DataFrame:
    """The items of the export files at path; see split_files."""
    return split_files(spark.read.format("binaryFile").load(path))


def split_files(files: DataFrame) -> DataFrame:
    """path, item_index and raw of every array element of the files; a row with run_error and a null index where a file ends a run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "item_index", "raw", "run_error"]
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                held, size, error = [], 0, None
                try:
                    for i, raw in split(content):
                        if i == 0 and not _first_fits(raw):
                            raise InputError("INPUT_NOT_CHATGPT_EXPORT")
                        if i >= P.MAX_ITEMS:
                            raise InputError("CONVERSATION_LIMIT_EXCEEDED")
                        held.append((name, i, raw, None))
                        size += len(raw)
                        if size > 4 << 20:
                            yield pd.DataFrame(held, columns=columns).astype({"item_index": "Int64"})
                            held, size = [], 0
                    last = None
                except InputError as e:
                    last = e.code
                    if last == "INVALID_JSON_ARRAY" and not held and not size:
                        last = "INPUT_NOT_CHATGPT_EXPORT" if not any(True for _ in _some(content)) else last
                error = last
                if error:
                    held.append((name, None, None, error))
                if held:
                    yield pd.DataFrame(held, columns=columns).astype({"item_index": "Int64"})

    return files.select("path", "content").mapInPandas(run, ITEMS)


def _first_fits(raw: str) -> bool:
    try:
        return is_conversation(parse(raw))
    except ValueError:
        return False


def _some(content: bytes) -> Iterator[int]:
    """Whether a first element could be read at all."""
    try:
        for i, _ in split(content):
            yield i
            return
    except InputError:
        return


def canonicalized(rows: DataFrame) -> DataFrame:
    """path, item_index, failure (a code or null) and the canonical columns of every item."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", CANONICAL)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, i, raw in zip(b["path"], b["item_index"], b["raw"], strict=True):
                try:
                    row, failure = canonical(parse(raw)), None
                except ItemError as e:
                    row, failure = {}, str(e)
                except (ValueError, RecursionError):
                    row, failure = {}, "INVALID_ITEM_JSON"
                out.append((path, i, failure, *(row.get(n) for n in names)))
            yield pd.DataFrame(out, columns=["path", "item_index", "failure", *names]).astype({"message_count": "Int64"})

    return rows.where(F.col("run_error").isNull()).select("path", "item_index", "raw").mapInPandas(run, f"path string, item_index long, failure string, {CANONICAL}")
