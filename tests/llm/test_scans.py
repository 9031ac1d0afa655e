import base64
import hashlib
import json
import re
import struct

import pytest

from foliant.llm import secrets, urls, warc


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + struct.pack(">H", n)) + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k]) * 40) for k in range(1, 9)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, b"k" * 40))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(3, b"k" * 60))
SSH = secrets.SSH_MAGIC + b"".join(struct.pack(">I", len(x)) + x for x in (b"none", b"none", b"")) + struct.pack(">I", 1) + b"".join(struct.pack(">I", len(x)) + x for x in (b"pub" * 9, b"priv" * 12))
b64 = lambda b: base64.b64encode(b).decode()
url64 = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")


def kinds(text):
    return [k for k, _, _ in secrets.find_secrets(text)]


def test_structures():
    assert kinds(f"x {b64(RSA)} y") == ["private_key"]
    assert kinds(f"x {b64(PKCS8)} y") == ["private_key"]
    assert kinds(f"x {b64(PUBLIC)} y") == [] == kinds(f"x {b64(RSA[:-3])} y")
    assert kinds(f"x {b64(SSH)} y") == ["ssh_key"] and kinds(f"x {b64(SSH[:-9])} y") == []
    assert kinds(f"x {RSA.hex()} y") == ["hex", "private_key"]
    lines = "\n".join(re.findall(".{1,64}", b64(RSA)))
    text = f"a\n-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----\nb"
    assert secrets.find_secrets(text) == [("private_key", 2, len(text) - 2)]
    token = f"{url64({'alg': 'HS256'})}.{url64({'sub': 1})}.abcd"
    assert kinds(token) == ["signed_token"] and kinds(token.replace("eyJ", "eyK")) == []


def plain(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_scan_against_plain_patterns(spark):
    texts = [None, "", "é token = \"" + "a1" * 14 + '"', "password: tok secret=abcdefg", "password: token: abcdef", "AKIA" + "B" * 16 + " AKIAAKIA", "\u017fecret=abcdefgh API_KEY='x.y=z-1'", "passwd==abcdef", "ab" * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, "", 1)], "doc_id int, text string, spans int")
    got = secrets.scan(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = sorted(plain(texts[r.doc_id] or ""), key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in base) for k in secrets.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
    assert secrets.scan(df.limit(0)).count() == 0
    clean = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(df.selectExpr("doc_id", "text", "7L AS n_chars")).collect()}
    assert clean[0] == (None, 7) and clean[2] == ('é [secret]"', 11) and clean[4] == (texts[4], 7)


def test_urls(spark):
    cases = {
        "https://a.example.com/en/70": ("a.example.com", "/en/70", "example.com/en/7", "allow"),
        "https://Example.COM/en/1?x#y": ("example.com", "/en/1", "com/en/", "block"),
        "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
        "http://x.example.net/de/85": ("x.example.net", "/de/85", "example.net/de/8", "block"),
        "http://spam-farm.example.org/en": ("spam-farm.example.org", "/en", None, "block"),
        "http://freeport.org/alphabet": ("freeport.org", "/alphabet", None, "allow"),
        "http://x.org/free?casino=1": ("x.org", "/free", None, "block"),
        "http://x.org/free-free": ("x.org", "/free-free", None, "allow"),
        "mailto:porn": ("", "", None, "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://?q://y": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    duckdb = pytest.importorskip("duckdb")
    pages = df.toPandas()
    con = duckdb.connect()
    con.register("pages", pages)
    same = con.sql(urls.judge_sql()).fetchall()
    assert {r[0]: r[1:5] for r in same} == got


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/ü b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (5, "u", "é" * 300_000), (None, "u", "only"), (None, "u", "<p>x</p>")]
    rows += [(100 + k, "u", f"<html><body><p>page {k} about {k % 7} things</p></body></html>") for k in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.plan_records(df), folder)
    got = warc.read_archives(spark, folder, manifest).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id == 1:
            assert r.record_type == "revisit" and r.refers_to == 2 and r.target_uri == "http://a/%C3%BC%20b%0D%0A" and r.payload_bytes == 8
        if r.page_id == 5:
            assert r.record_type == "response" and bytes(r.payload).decode() == "é" * 300_000
        if r.page_id in (2, 4):
            assert r.record_type == "response"
    assert sum(r.record_type == "revisit" for r in got) == 3
    assert {r.refers_to for r in got if r.page_id == 3} == {4}
    assert {r.record_type for r in warc.round_trip(df, min_bytes=10**9).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_checks():
    raws = [warc.record(k, "u", f"<p>some words of page {k} and more of them</p>".encode() * 9, "response", None) for k in range(400)]
    data = warc.pack(raws)
    assert struct.unpack_from("<I", data)[0] == warc.DICT_MAGIC and list(warc.unpack(data)) == raws
    with pytest.raises(warc.ArchiveError):
        list(warc.unpack(data[:-5]))
    for bad in (raws[0].replace(b"WARC/1.1", b"WARC/9"), raws[0].replace(b"some", b"same"), raws[0] + b"x", raws[0].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)


def test_key_encodings():
    lines = lambda b, n=64: "\n".join(re.findall(f".{{1,{n}}}", b64(b)))
    pem = lambda body: f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    whole = lambda text, kind: [(kind, 2, 2 + len(text))]
    locked = pem("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123ABCD\n\n" + lines(bytes(range(7, 199))))
    for text in (locked, pem(lines(RSA)).replace("\n", "\\n"), pem(lines(RSA)).replace("\n", "\\r\\n"), locked.replace("\n", "\\n")):
        assert secrets.find_secrets(f'x"{text}" y') == whole(text, "private_key")
    for raw, kind in ((RSA, "private_key"), (PKCS8, "private_key"), (SSH, "ssh_key")):
        for text in (lines(raw), lines(raw, 76).replace("\n", "\r\n  "), lines(raw, 32).replace("\n", "\\n"), b64(raw)):
            assert secrets.find_secrets(f"a {text}\nand more\n") == whole(text, kind)
            assert secrets.find_secrets(f"\\n{text}\\nand") == whole(text, kind)
        assert secrets.redacted(f"a\n{lines(raw)}\n{lines(raw)}\nb") == "a\n[secret]\n[secret]\nb"
    assert kinds(lines(PUBLIC)) == [] == kinds(lines(RSA[:-3]) + "\nx") == kinds(pem(lines(PUBLIC)))


def test_url_weights(spark):
    heavy = urls.Filter(rules=(), soft_limit=3, weights={"casino": 2.5, "bonus": 0.5}).build()
    # One term alone never rejects; two do where their weights reach the limit.
    verdicts = {u: heavy.judge(u)[3] for u in ("http://a/casino", "http://a/casino/casino", "http://a/casino/bonus", "http://a/bonus/free", "http://a/free/loan/win", "http://a/xxx")}
    assert list(verdicts.values()) == ["allow", "allow", "block", "allow", "block", "block"]
    pages = spark.createDataFrame([(1, "http://a/" + "x/" * 50_000 + "free/loan", "no host"), (1, None, None), (2, "http://b/free", "x")], "page_id long, url string, host string")
    assert sorted((r.page_id, r.verdict, r.host) for r in urls.judge_urls(pages).collect()) == [(1, "allow", ""), (1, "block", "a"), (2, "allow", "b")]
    assert urls.judge_urls(pages.limit(0)).collect() == []
