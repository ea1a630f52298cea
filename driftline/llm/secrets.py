"""Secrets in texts: fixed shapes, and candidates that are reported only once their structure is confirmed.

The fixed shapes (assignments, access keys, long hex runs) are reported as they stand. Anything that merely looks like
base64 or hex is decoded first and must then parse: a signed token's header must be JSON that names an algorithm, a private
key must be DER whose nested lengths fill the buffer exactly down to the innermost value and whose values are those of a kind of
private key, an SSH private key must be the frame with all of its length-prefixed fields, and an armoured block must hold such a
body. Public keys and certificates are no secrets and aren't reported.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
# The shapes of the base rules.
ASSIGN = re.compile(r"(?a)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# A quick look at whether a word of ASSIGN can occur at all.
HINT = re.compile(r"(?ai)passw|secret|token|api_?key")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
#: Runs that may be encoded; two or more dots make a signed token, other runs are base64 or hex. 40 characters hold 30 bytes.
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9_-]+){2}|[A-Za-z0-9+/_-]{40,}={0,2}")
LONG = re.compile(r"[A-Za-z0-9+/_-]{16}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE)[A-Z0-9 ]*)-----((?:[A-Za-z0-9+/=\s]++|\\[nrt/])*+)-----END \1-----")
#: What starts a JSON object, a DER sequence or an SSH frame inside of a run; and runs with the lines that go on with them, where line
#: ends may be written as escapes.
HEADER = re.compile(r"e(?=[w-z0-3][A-Za-z0-9+/_-]{9})")
RUN = re.compile(r"[A-Za-z0-9+/_-]*+")
REST = re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
INNER = re.compile(r"M(?=[A-P])|b(?=3BlbnNzaC1rZXktdjEA)")
SSH_FRAME = b"openssh-key-v1\0"
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{40,}+(?:(?:[\x20\t]*+(?:\r?\n|\\[nr]))++[\x20\t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
BREAK = re.compile(r"\\[nr]|[\s=]")
DEEPEST = 12
#: A private key's outer sequence has ten values at most.
MOST_VALUES = 16


def unbase64(s: str) -> bytes | None:
    """Decodes either alphabet, padded or not; None if the run cannot be base64."""
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


Der = tuple[int, "bytes | list[Der]"]


def der_values(data: bytes, depth: int = 0) -> list[Der] | None:
    """Tags and contents (of sequences and sets, their values) if data is a row of DER values whose nested lengths fill it exactly,
    else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > DEEPEST:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        content: bytes | list[Der] | None = data[at : at + length]
        if tag in (0x30, 0x31) or 0xA0 <= tag <= 0xAF:
            content = der_values(content, depth + 1)
            if content is None:
                return None
        elif tag == 0x02:  # a whole number in as few bytes as it needs
            if not content or len(content) > 1 and (content[0] == 0 and content[1] < 0x80 or content[0] == 0xFF and content[1] >= 0x80):
                return None
        elif tag not in (0x01, 0x03, 0x04, 0x05, 0x06, 0x0A, 0x0C, 0x13, 0x16, 0x17, 0x18) and not 0x80 <= tag <= 0x8F:
            return None
        out.append((tag, content))
        at += length
    return out


def _algorithm(value: Der) -> bool:
    return value[0] == 0x30 and bool(value[1]) and value[1][0][0] == 0x06


def is_der_key(data: bytes) -> bool:
    """One outer sequence that fills data and is a private key: a version, an algorithm and a string that is such a key or a bare one; a
    version and other values, long numbers or strings among them; or an algorithm and an encrypted string."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    outer = der_values(data)
    if not outer or len(outer) != 1 or len(outer[0][1]) < 2:
        return False
    first, second, *rest = values = outer[0][1]
    small = first[0] == 0x02 and len(first[1]) == 1 and first[1][0] < 3
    if small and _algorithm(second):
        inner = der_values(rest[0][1]) if rest and rest[0][0] == 0x04 and all(t in (0xA0, 0x81, 0xA1) for t, _ in rest[1:]) else None
        return inner is not None and len(inner) == 1 and (inner[0][0] in (0x02, 0x04) and len(inner[0][1]) >= 16 or is_der_key(rest[0][1]))
    if small:
        return any(t in (0x02, 0x04) and len(c) >= 16 for t, c in values)
    # an encrypted key is whole blocks; a public key in this place would be a bit string
    return len(values) == 2 and _algorithm(first) and len(first[1]) == 2 and second[0] == 0x04 and len(second[1]) >= 32 and len(second[1]) % 8 == 0


def is_ssh_key(data: bytes) -> bool:
    """The frame of a private key: names of cipher, derivation and its options, how many keys, that many public keys, each of fields that
    start with a key type, and the private part, in whole blocks, all of which fill data."""
    if not data.startswith(SSH_FRAME):
        return False

    def field(at: int) -> tuple[bytes, int] | None:
        n = int.from_bytes(data[at : at + 4], "big")
        return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) else None

    at, heads = len(SSH_FRAME), []
    for _ in range(3):
        if (got := field(at)) is None:
            return False
        heads.append(got[0])
        at = got[1]
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not re.fullmatch(rb"[a-z0-9@.-]+", heads[0]) or heads[1] not in (b"none", b"bcrypt") or not 1 <= keys <= 16:
        return False
    for _ in range(keys):
        if (got := field(at)) is None or not re.match(rb"\0\0\0[\x07-\x40](?:ssh|ecdsa|sk-ssh|sk-ecdsa)-", got[0]):
            return False
        at = got[1]
    got = field(at)
    return got is not None and got[1] == len(data) and len(got[0]) >= 32 and len(got[0]) % 8 == 0


def is_signed_token(s: str) -> bool:
    """Three dotted parts: a JSON header that names an algorithm, a JSON payload and a signature that decodes."""
    head, payload, *rest = s.split(".")
    try:
        header = json.loads(unbase64(head) or b"")
        body = json.loads(unbase64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict) and unbase64(rest[0]) is not None


def confirmed(run: str) -> str | None:
    """The kind of secret that a run of encoded characters holds, if its structure shows one."""
    if "." in run:
        return "jwt" if is_signed_token(run) else None
    for data in ([bytes.fromhex(run)] if len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run) else []) + [unbase64(run)]:
        if data:
            if is_der_key(data):
                return "der"
            if is_ssh_key(data):
                return "ssh"
    return None


class Decoded:
    """Bytes of a base64 run from a place on, decoded only where they are asked for."""

    def __init__(self, run: str, at: int, end: int | None = None):
        self.run, self.at, self.end = run, at, len(run) if end is None else end
        self.length = (self.end - at) * 3 // 4

    def part(self, start: int, end: int) -> bytes:
        first, last = start // 3, -(-min(end, self.length) // 3)
        return (unbase64(self.run[self.at + 4 * first : min(self.at + 4 * last, self.end)]) or b"")[start - 3 * first : end - 3 * first]

    def number(self, start: int) -> int | None:
        four = self.part(start, start + 4)
        return int.from_bytes(four, "big") if len(four) == 4 else None


def json_size(head: Decoded) -> int | None:
    """How many bytes the JSON object at the beginning has, with the blanks behind it; None if there is none. What is no JSON shows within a
    window of the text, which grows only while the object goes on."""
    window = 256
    while True:
        raw = head.part(0, window)
        text = raw.decode("utf-8", "replace")
        try:
            end = json.JSONDecoder().raw_decode(text)[1]
            if "\ufffd" in text[:end]:  # it may be meant, or no UTF-8
                return head.length
            return len(text[: len(text) - len(text[end:].lstrip(" \t\r\n"))].encode())
        except RecursionError:
            return None
        except ValueError as e:
            unfinished = isinstance(e, json.JSONDecodeError) and (e.pos >= len(text) - 8 or e.msg.startswith("Unterminated"))
            if window >= head.length or not unfinished:
                return None
            window *= 4


def inner_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Signed tokens wherever their header starts, also behind other characters of the alphabet. A run's end and what follows it are
    looked up once for all headers that may start in it, and only a header whose JSON ends with the run is read whole."""
    upto, stop, rest = 0, -1, None
    for m in HEADER.finditer(text):
        at = m.start()
        if at < upto or not re.match(rb"\{\s*\"", unbase64(text[at : at + 12]) or b""):
            continue
        if at >= stop:
            stop = RUN.match(text, at).end()
            rest = REST.match(text, stop)
        if rest is None:
            continue
        head = Decoded(text, at, stop)
        if json_size(head) == head.length and is_signed_token(text[at:stop] + rest[0]):
            upto = rest.end()
            yield at, upto


def key_size(data: Decoded) -> int:
    """How many bytes a DER sequence has in all that may be a private key, as its own header and those of its values say; 0 for others. Values
    are stepped over by their lengths, of which a key has few, so that only what may be one is decoded whole."""

    def header(at: int) -> tuple[int, int, int] | None:
        """Tag, where the content begins, and where it ends."""
        raw = data.part(at, at + 6)
        size = der_size(raw)
        return (raw[0], at + 2 + (raw[1] & 0x7F if raw[1] & 0x80 else 0), at + size) if size else None

    outer = header(0)
    if outer is None or not 24 <= outer[2] <= data.length:
        return 0
    at, seen = outer[1], 0
    while at < outer[2]:
        own = header(at)
        if own is None or own[2] > outer[2] or seen > MOST_VALUES:
            return 0
        if not seen:
            small = own[0] == 0x02 and own[2] == own[1] + 1 and data.part(own[1], own[2])[0] < 3
            if not small and not (own[0] == 0x30 and data.part(own[1], own[1] + 1) == b"\x06"):
                return 0
        at, seen = own[2], seen + 1
    return outer[2] if seen >= 2 else 0


def frame_size(data: Decoded) -> int:
    """How many bytes an SSH frame has in all, by the lengths of its fields; 0 if they don't lead to an end within data."""
    at = len(SSH_FRAME)
    for _ in range(3):
        n = data.number(at)
        if n is None or n > data.length:
            return 0
        at += 4 + n
    keys = data.number(at)
    if keys is None or not 1 <= keys <= 16:
        return 0
    at += 4
    for _ in range(keys + 1):
        n = data.number(at)
        if n is None or at + 4 + n > data.length:
            return 0
        at += 4 + n
    return at


def der_size(data: bytes) -> int:
    """How many bytes the DER value that data starts with has in all, as its header says; 0 if it says none."""
    if len(data) < 2 or data[1] < 0x80:
        return 2 + data[1] if len(data) > 1 else 0
    n = data[1] & 0x7F
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 and len(data) >= 2 + n else 0


def inner_keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys wherever they start in a run, whatever follows them there, and also over the ends of lines. A key says its own length; it is
    decoded once its headers lead there, and an SSH frame must end with a line."""
    for m in WRAPPED.finditer(text):
        if not INNER.search(m[0]):
            continue
        run, places = _unbroken(m[0])
        upto, last_failed = 0, -1
        for start in INNER.finditer(run):
            at = start.start()
            if at < upto:
                continue
            data, kind = Decoded(run, at), None
            if run[at] == "M":
                size = key_size(data)
                end = at + -(-size * 4 // 3)
                if size and is_der_key(unbase64(run[at:end]) or b""):
                    kind = "der"
            else:
                size = frame_size(data)
                end = at + -(-size * 4 // 3)
                if size and end != last_failed and (end == len(run) or places[end] > places[end - 1] + 1):
                    kind = "ssh" if is_ssh_key(unbase64(run[at:end]) or b"") else None
                    last_failed = -1 if kind else end
            if kind:
                upto, last = end, m.start() + int(places[end - 1]) + 1
                yield kind, m.start() + int(places[at]), last + len(re.match("={0,2}", text[last : last + 2])[0])


def _unbroken(wrapped: str) -> tuple[str, range | array]:
    """A run without its line ends, and where each of its characters stood."""
    places, pieces, at = array("q"), [], 0
    for b in BREAK.finditer(wrapped):
        pieces.append(wrapped[at : b.start()])
        places.extend(range(at, b.start()))
        at = b.end()
    if not pieces:
        return wrapped, range(len(wrapped))
    pieces.append(wrapped[at:])
    places.extend(range(at, len(wrapped)))
    return "".join(pieces), places


def _apart(spans: list[tuple[str, int, int]], sure: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Spans that lie in none of those that are sure."""
    held = sorted((s, e) for _, s, e in sure)
    starts, ends = [s for s, _ in held], list(accumulate((e for _, e in held), max))
    for kind, s, e in spans:
        k = bisect_right(starts, s)
        if not k or ends[k - 1] < e:
            yield kind, s, e


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a whole text, by start and then kind; end exclusive, in code points."""
    if not text:
        return []
    out = []
    if HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if LONG_HEX.search(text):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    sure = []
    if LONG.search(text):
        sure += [(kind, m.start(), m.end()) for m in ENCODED.finditer(text) if (kind := confirmed(m[0]))]
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            body = unbase64(re.sub(r"\\[nrt]|\s", "", m[2]).replace("\\/", "/"))
            if body and (is_der_key(body) or is_ssh_key(body)):
                sure.append(("pem", m.start(), m.end()))
    if LONG.search(text):
        more = [("jwt", *span) for span in inner_tokens(text)] + list(inner_keys(text))
        sure += list(_apart(more, sure))
    out += sure
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _each(docs: DataFrame, schema: str, types: dict[str, pa.DataType], row: Callable[[str | None, list[tuple[str, int, int]]], tuple]) -> DataFrame:
    """doc_id and what row makes of a text and its spans, one row for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [row(t, find(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate(types.values()))], names=["doc_id", *types])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, {schema}")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id and spans, an array of (kind, start, end, value).

    docs needs doc_id and text, whatever else it has. A null or empty text has no spans; a null doc_id is carried
    through; repeated rows and ties give repeated rows; no rows give no rows. Texts are searched whole.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    values = lambda t, spans: ([{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in spans],)
    return _each(docs, "spans array<struct<kind: string, start: bigint, end: bigint, value: string>>", {"spans": kind}, values)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span found replaced by mark (overlapping spans by one) and n_chars, if there, set to match.

    Columns, rows and their order of columns stay, whatever other columns there are. A text without secrets, empty or null, stays as it
    is; repeated rows are each treated so; a table without rows gives one without rows. Texts are searched whole.
    """
    small_batches(docs.sparkSession)
    names = docs.columns

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for _, s, e in find(text):
            if e <= at:
                continue
            if s >= at:
                out += [text[at:s], mark]
            at = e
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [clean(t) for t in b.column("text").to_pylist()]
            columns = [pa.array(texts, b.schema.field("text").type) if n == "text" else b.column(n) for n in names]
            if "n_chars" in names:
                k = names.index("n_chars")
                old, kept = columns[k].to_pylist(), b.column("text").to_pylist()
                columns[k] = pa.array([o if t == u else len(u) for o, t, u in zip(old, kept, texts, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans that scan() finds, one row for each row of docs; nulls and the like as there."""

    def row(text: str | None, spans: list[tuple[str, int, int]]) -> tuple:
        base = [s for s in spans if s[0] in KINDS[:3]]
        counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
        return *counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), len(spans) - len(base)

    types = dict.fromkeys(["n_assign", "n_access", "n_hex"], pa.int64()) | {"base_sha256": pa.string(), "spans": pa.string(), "n_confirmed": pa.int64()}
    return _each(docs, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint", types, row)
