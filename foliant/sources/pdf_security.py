"""Encrypted PDF files: the standard handler's revisions 2 to 4, with RC4 or AES in 128 bits.

Files that only restrict printing open with the empty password. Revisions 5 and 6 are not opened."""

from __future__ import annotations

import hashlib

# Fixed value: what passwords are padded with.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out.append(byte ^ box[(box[i] + box[j]) & 255])
    return bytes(out)


def product(a: int, b: int) -> int:
    """Of two elements of the field that AES works in."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def substitution() -> list[int]:
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if product(a, b) == 1)
            inverse[a], inverse[b] = b, a
    turn = lambda x, n: ((x << n) | (x >> (8 - n))) & 255
    return [x ^ turn(x, 1) ^ turn(x, 2) ^ turn(x, 3) ^ turn(x, 4) ^ 0x63 for x in inverse]


TABLES: dict = {}


def tables() -> dict:
    if not TABLES:
        box = substitution()
        back = [0] * 256
        for k, v in enumerate(box):
            back[v] = k
        TABLES.update(box=box, back=back, mul={n: [product(n, x) for x in range(256)] for n in (9, 11, 13, 14)})
    return TABLES


def round_keys(key: bytes) -> list[bytes]:
    box, words, step = tables()["box"], [key[k : k + 4] for k in range(0, 16, 4)], 1
    for k in range(4, 44):
        word = words[-1]
        if k % 4 == 0:
            word = bytes([box[word[1]] ^ step, box[word[2]], box[word[3]], box[word[0]]])
            step = product(step, 2)
        words.append(bytes(a ^ b for a, b in zip(words[k - 4], word, strict=True)))
    return [b"".join(words[k : k + 4]) for k in range(0, 44, 4)]


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """Decrypted blocks after the first, which is the start value; padding removed."""
    t, keys = tables(), round_keys(key)
    back, m9, m11, m13, m14 = t["back"], *(t["mul"][n] for n in (9, 11, 13, 14))
    source = [(k - 4 * (k % 4)) % 16 for k in range(16)]
    out, before = bytearray(), data[:16]
    for start in range(16, len(data) - 15, 16):
        block = data[start : start + 16]
        state = [a ^ b for a, b in zip(block, keys[10], strict=True)]
        for n in range(9, -1, -1):
            state = [back[state[source[k]]] ^ keys[n][k] for k in range(16)]
            if n:
                mixed = []
                for c in range(0, 16, 4):
                    p, q, r, s = state[c : c + 4]
                    mixed += [m14[p] ^ m11[q] ^ m13[r] ^ m9[s], m9[p] ^ m14[q] ^ m11[r] ^ m13[s], m13[p] ^ m9[q] ^ m14[r] ^ m11[s], m11[p] ^ m13[q] ^ m9[r] ^ m14[s]]
                state = mixed
        out += bytes(a ^ b for a, b in zip(state, before, strict=True))
        before = block
    return bytes(out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out)


class Lock:
    """The key of a file, and how its strings and streams are decrypted."""

    def __init__(self, key: bytes, aes: bool):
        self.key, self.aes = key, aes

    @classmethod
    def open(cls, spec: dict, first_id: bytes, password: str) -> Lock | None:
        """None if the password doesn't open the file or the method isn't known."""
        version, revision = int(spec.get("V") or 0), int(spec.get("R") or 2)
        if version not in (1, 2, 4) or not all(isinstance(spec.get(k), bytes) for k in "OU"):
            return None
        method, length = "V2", (int(spec.get("Length") or 40) // 8) if version > 1 else 5
        if version == 4:
            filters = spec.get("CF") or {}
            method = (filters.get(spec.get("StmF")) or {}).get("CFM") or "None"
            length = 16
            if method not in ("V2", "AESV2"):
                return None
        raw = password.encode("latin-1", "replace")
        for trial in (raw, cls.owner(spec, raw, revision, length)):
            key = cls.file_key(spec, first_id, trial, revision, length)
            if cls.proof(key, first_id, revision) == spec["U"][: 32 if revision == 2 else 16]:
                return cls(key, method == "AESV2")
        return None

    @staticmethod
    def owner(spec: dict, raw: bytes, revision: int, length: int) -> bytes:
        """The user's password by the owner's."""
        key = hashlib.md5((raw + PADDING)[:32], usedforsecurity=False).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key, usedforsecurity=False).digest()
        text = spec["O"][:32]
        for n in range(19 if revision >= 3 else 0, -1, -1):
            text = rc4(bytes(b ^ n for b in key[:length]), text)
        return text

    @staticmethod
    def file_key(spec: dict, first_id: bytes, raw: bytes, revision: int, length: int) -> bytes:
        rights = (int(spec.get("P") or 0) & 0xFFFFFFFF).to_bytes(4, "little")
        open_about = b"\xff" * 4 if revision >= 4 and spec.get("EncryptMetadata") is False else b""
        key = hashlib.md5((raw + PADDING)[:32] + spec["O"][:32] + rights + first_id + open_about, usedforsecurity=False).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:length], usedforsecurity=False).digest()
        return key[:length]

    @staticmethod
    def proof(key: bytes, first_id: bytes, revision: int) -> bytes:
        if revision == 2:
            return rc4(key, PADDING)
        text = hashlib.md5(PADDING + first_id, usedforsecurity=False).digest()
        for n in range(20):
            text = rc4(bytes(b ^ n for b in key), text)
        return text

    def decrypt(self, number: int, data: bytes) -> bytes:
        salt = number.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if self.aes else b"")
        key = hashlib.md5(self.key + salt, usedforsecurity=False).digest()[: min(16, len(self.key) + 5)]
        return aes_cbc(key, data) if self.aes else rc4(key, data)

    def plain(self, number: int, value, stream: type):
        """A value with all strings and streams decrypted; cross-reference streams are never encrypted."""
        if isinstance(value, stream):
            if value.head.get("Type") != "XRef":
                return stream(self.plain(number, value.head, stream), self.decrypt(number, value.raw))
        elif isinstance(value, bytes):
            return self.decrypt(number, value)
        elif type(value) is list:
            return [self.plain(number, v, stream) for v in value]
        elif isinstance(value, dict):
            return {k: self.plain(number, v, stream) for k, v in value.items()}
        return value
