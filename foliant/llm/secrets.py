"""Secret scans with structural confirmation.

Plain patterns find assignments, access ids and long hex runs. Candidates of key
material are decoded first (base64 or hex) and reported only if the bytes have
the structure of a private key, nested lengths included, or, for signed tokens,
if header and claims parse.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "private_key", "ssh_key", "signed_token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]+|-(?!----))*+)-----END \1-----")
#: Starts of base64 keys; a line end before them may be written as a backslash and a letter.
BASE64 = re.compile(r"M(?:(?<![A-Za-z0-9+/_-]M)|(?<=\\[nr]M))[A-P][A-Za-z0-9+/_-]{10}")
SSH = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))b3BlbnNzaC1rZXktdjE")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
PADDING = re.compile("={0,2}")
#: A line end, real or written with backslashes, and white space around it.
BREAK = re.compile(r"[ \t]*(?:\r\n?|\n|\\+r\\+n|\\+n)[ \t]*")
ESCAPED = re.compile(r"\\+[rnt]")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{62,}|6[fF]70656[eE]7373682[dD]6[bB]6579[0-9A-Fa-f]{60,})")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+|[A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
SSH_MAGIC = b"openssh-key-v1\x00"


def unbase64(text: str) -> bytes | None:
    core = text.translate({43: "-", 47: "_"}).rstrip("=")
    try:
        return base64.urlsafe_b64decode(core + "=" * (-len(core) % 4))
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and bodies that fill ``data`` exactly, or None if lengths don't nest."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            n, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + n > len(data):
            return None
        found.append((tag, data[at : at + n]))
        at += n
    return found


def is_private_key(data: bytes | None) -> bool:
    """DER of a private key: RSA, DSA or EC numbers, or the wrapped forms with an
    algorithm identifier, plain or encrypted. Public keys don't count."""
    outer = der_items(data) if data else None
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if len(tags) in (6, 9) and all(t == 0x02 and body for t, body in inner) and inner[0][1] in (b"\x00", b"\x01"):
        return True
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\x01" and len(inner[1][1]) >= 16:
        return all(t in (0xA0, 0xA1) and der_items(body) for t, body in inner[2:])
    algorithm = (der_items(inner[1][1]) if tags[:3] == [0x02, 0x30, 0x04] else der_items(inner[0][1]) if tags == [0x30, 0x04] else None) or [(0, b"")]
    return algorithm[0][0] == 0x06 and bool(algorithm[0][1]) and len(inner[-1 if tags == [0x30, 0x04] else 2][1]) >= 16


def ssh_length(data: bytes | None) -> int:
    """Bytes of the open SSH container at the start of ``data``: three strings, a count, then
    public and private parts, with lengths that nest; 0 if there is none."""
    if not data or not data.startswith(SSH_MAGIC):
        return 0
    at = len(SSH_MAGIC)

    def piece() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        short = at + 4 > len(data) or len(body) < n
        at += 4 + n
        return None if short else body

    head = [piece() for _ in range(3)]
    if None in head or not head[0] or not head[1]:
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return 0
    parts = [piece() for _ in range(keys + 1)]
    return at if all(p for p in parts) else 0


def is_ssh_key(data: bytes | None) -> bool:
    return ssh_length(data) > 0


def gather(text: str, at: int, need: int | None = None) -> tuple[str, int]:
    """Base64 from ``at`` on over line ends, by whole runs until there are ``need`` characters, and where it ends."""
    runs, n, end = [], 0, at
    while run := RUN.match(text, at):
        runs.append(run[0])
        n, end = n + len(run[0]), run.end()
        following = BREAK.match(text, end)
        if need is not None and n >= need or not following:
            break
        at = following.end()
    return "".join(runs), end


def base64_der(text: str, at: int) -> int:
    """End of the private key whose base64 starts at ``at``, on one line or several; 0 if there is none."""
    head = unbase64(text[at : at + 12]) or b""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    if more > 4:
        return 0
    total = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if head[1] & 0x80 else head[1])
    need = -(-total * 4 // 3)
    code, end = gather(text, at, need)
    return PADDING.match(text, end).end() if need >= 40 and len(code) == need and is_private_key(unbase64(code)) else 0


def base64_ssh(text: str, at: int) -> int:
    """The same for an open SSH container, whose length is that of its parts."""
    code, _ = gather(text, at)
    used = ssh_length(unbase64(code[: len(code) - (len(code) % 4 == 1)]))
    return PADDING.match(text, gather(text, at, -(-used * 4 // 3))[1]).end() if used else 0


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    """A JSON header that names an algorithm; claims are an object, or opaque if
    the header says that the content is encrypted or not JSON."""
    try:
        head = json.loads(unbase64(header) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or len(header.rstrip("=")) % 4 == 1:
        return False
    if not signature and head["alg"].lower() != "none":
        return False
    if "b64" in head or "cty" in head:
        return True
    try:
        return isinstance(json.loads(unbase64(claims) or b""), dict)
    except (ValueError, RecursionError):
        return False


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) by start, then kind."""
    if not text:
        return []
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            body = unbase64("".join("".join(line.split()) for line in ESCAPED.sub("\n", m[2]).splitlines() if ":" not in line))
            # Encrypted old-style blocks have headers with a colon; their body is opaque.
            if is_private_key(body) or is_ssh_key(body) or (body and "Proc-Type:" in m[2]):
                found.append(("ssh_key" if m[1].startswith("OPENSSH") else "private_key", m.start(), m.end()))
    blocks = [(s, e) for k, s, e in found if k in ("private_key", "ssh_key")]
    starts = [("private_key", BASE64, base64_der)] + ([("ssh_key", SSH, base64_ssh)] if "b3BlbnNzaC1rZXktdjE" in text else [])
    for kind, pattern, end_of in starts:
        for m in pattern.finditer(text):
            if not any(s <= m.start() < e for s, e in blocks) and (end := end_of(text, m.start())):
                found.append((kind, m.start(), end))
    for m in HEX_KEY.finditer(text):
        data = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 else None
        if is_private_key(data) or is_ssh_key(data):
            found.append(("private_key" if m[0].startswith("30") else "ssh_key", m.start(), m.end()))
    if "eyJ" in text:
        found += [("signed_token", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts of the base kinds, a digest of
    their spans and all spans as text. Null counts as empty: no spans. Repeated
    rows stay; other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column(1).to_pylist():
                spans = find_secrets(text)
                base = [x for x in spans if x[0] in KINDS[:3]]
                for k in range(3):
                    out[k].append(sum(x[0] == KINDS[k] for x in base))
                out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[4].append(joined(spans))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=names)

    slim = pick(docs, [id_col, text_col])
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """``text`` with each run of overlapping spans replaced by ``mark``; text without spans as it is."""
    out, done, open_until = [], 0, -1
    for _, s, e in find_secrets(text):
        if s >= open_until:
            out += [text[done:s], mark]
        open_until = done = max(open_until, e)
    return text if not out else "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text_col`` replaced;
    ``length_col``, if there is one, is counted anew for texts that changed."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(text_col).to_pylist()
            new = [redacted(t) for t in old]
            columns = {n: b.column(n) for n in b.schema.names}
            columns[text_col] = pa.array(new, columns[text_col].type)
            if length_col in columns:
                was = columns[length_col].to_pylist()
                columns[length_col] = pa.array([w if a == t else len(t) for w, a, t in zip(was, old, new, strict=True)], columns[length_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)
