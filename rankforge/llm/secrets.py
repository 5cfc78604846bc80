"""Secret scan: pattern candidates, then structural confirmation.

Base kinds are found by pattern alone. Further candidates (long base64 runs, hex runs, dotted tokens,
armoured blocks) are reported only after their bytes confirm what they claim to be: base64 or hex is
decoded and parsed as a DER key with every nested length consistent, as an OpenSSH key whose length
fields close, or as a signed token whose header is JSON with a known algorithm.

Texts are whole; spans are code points, end exclusive."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in their order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "der_key", "ssh_key", "armour")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Base64 runs, also wrapped over lines, and where in one a key may begin: at its start or behind a sign that names and paths use too, with the characters
#: that a SEQUENCE, an OpenSSH public key or the private container begin with.
_B64 = re.compile(r"[A-Za-z0-9+/_-]{40,}+(?:\r?\n[A-Za-z0-9+/_-]{4,}+)*+={0,2}")
_BEGIN = re.compile(r"(?:(?<=[_/+-])|^)(?:M[A-P]|AAAA|b3BlbnNzaC1rZXkt)")
_ANYHEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}+")
#: Three parts with dots between; a run is tried once, from its start.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
_HEADER = re.compile(r"(?:(?<=[_-])|^)ey")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*+)-----END \1-----", re.S)
#: Signature algorithms that a token header may name (fixed values).
ALGORITHMS = ("HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES256K", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA", "none")


def decode64(s: str) -> bytes | None:
    """Bytes of a base64 text in either alphabet, padding optional; None if it is not base64."""
    s = re.sub(r"[\x09-\x0D\x20]+", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(b: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """``(tag, start, end)`` of the elements that fill ``b[start:end]`` exactly; None if a length does not fit."""
    out = []
    while start < end:
        if start + 2 > end:
            return None
        tag, n, at = b[start], b[start + 1], start + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(b[at:at + k], "big"), at + k
            if n < 0x80 or (k > 1 and n < 1 << 8 * (k - 1)):  # lengths are minimal in DER
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        start = at + n
    return out


def is_der_key(b: bytes | None) -> bool:
    """A private or public key: one SEQUENCE that fills the bytes and holds what a key encoding holds, down to the key inside a PKCS#8 wrapping."""
    if not b or b[0] != 0x30 or not (top := der_items(b, 0, len(b))) or len(top) != 1:
        return False
    inner = der_items(b, top[0][1], top[0][2])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    if tags[:3] == [0x02, 0x30, 0x04] or tags == [0x30, 0x03]:  # PKCS#8, or a public key: an algorithm with an object id
        alg, held = (inner[1], inner[2]) if tags[0] == 0x02 else (inner[0], inner[1])
        parts = der_items(b, alg[1], alg[2])
        if not parts or parts[0][0] != 0x06:
            return False
        if tags[0] == 0x30:  # a bit string without spare bits
            return held[2] - held[1] > 1 and b[held[1]] == 0
        within = der_items(b, held[1], held[2])
        return bool(within) and len(within) == 1 and (within[0][0] == 0x04 or within[0][0] == 0x02 or within[0][0] == 0x30 and bool(der_items(b, within[0][1], within[0][2])))
    if len(tags) in (6, 9) and set(tags) == {0x02}:  # PKCS#1 or DSA: a version and integers
        return inner[0][2] - inner[0][1] == 1
    return len(tags) >= 2 and tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1}  # SEC 1


def der_size(head: bytes) -> int | None:
    """Bytes of the SEQUENCE that begins with ``head``, by its own length; None if it does not begin with one."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    n = head[1]
    if n < 0x80:
        return 2 + n
    k = n & 0x7F
    return 2 + k + int.from_bytes(head[2:2 + k], "big") if 1 <= k <= 4 else None


def ssh_fields(b: bytes, at: int, n: int | None = None) -> tuple[list[bytes], int] | None:
    """``n`` length-prefixed fields from ``at`` on (or all to the end of the bytes), and where they end; None if one does not fit."""
    out = []
    while len(out) != n and (n is not None or at < len(b)):
        if at + 4 > len(b):
            return None
        size = int.from_bytes(b[at:at + 4], "big")
        if at + 4 + size > len(b):
            return None
        out.append(b[at + 4:at + 4 + size])
        at += 4 + size
    return out, at


_SSH_TYPE = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-|sk-(ssh|ecdsa))")
_SSH_MAGIC = b"openssh-key-v1\0"


def _is_ssh_public(b: bytes) -> bool:
    got = ssh_fields(b, 0)
    return got is not None and len(got[0]) >= 2 and bool(_SSH_TYPE.match(got[0][0]))


def is_ssh_key(b: bytes | None) -> bool:
    """OpenSSH: a public key whose length-prefixed fields end where the bytes end, or the private container: cipher, key derivation and its options, as
    many public keys as it says, and the private part, which ends it."""
    if not b:
        return False
    if not b.startswith(_SSH_MAGIC):
        return _is_ssh_public(b)
    head = ssh_fields(b, len(_SSH_MAGIC), 3)
    if head is None or head[1] + 4 > len(b) or not head[0][0]:
        return False
    n = int.from_bytes(b[head[1]:head[1] + 4], "big")
    rest = ssh_fields(b, head[1] + 4)
    return rest is not None and 1 <= n == len(rest[0]) - 1 and all(map(_is_ssh_public, rest[0][:-1])) and len(rest[0][-1]) % 8 == 0 and len(rest[0][-1]) > 0


def _object(part: str) -> dict | None:
    """The JSON object that a token part holds. The text is decoded piece by piece, so that what is no JSON costs its good beginning only."""
    size = 64
    while True:
        b = decode64(part[:size - size % 4] if size < len(part) else part)
        if b is None:
            return None
        try:
            x = json.loads(b.decode("utf-8", "strict" if size >= len(part) else "ignore"))
            return x if isinstance(x, dict) and size >= len(part) else None
        except json.JSONDecodeError as e:
            if size >= len(part) or e.pos < len(b) - 8 and not e.msg.startswith("Unterminated string"):
                return None
        except (ValueError, RecursionError):
            return None
        size *= 4


def is_signed_token(token: str) -> bool:
    """Header and payload are JSON objects, the header names an algorithm, the signature is there unless it is ``none``."""
    head, body, sign = token.split(".")
    h = _object(head)
    if h is None or h.get("alg") not in ALGORITHMS or _object(body) is None:
        return False
    return h["alg"] == "none" or len(decode64(sign) or b"") >= 16


def _is_armoured(body: str) -> bool:
    """Base64 of a key; with header lines that declare it encrypted, base64 of whole cipher blocks."""
    lines = body.strip().splitlines()
    heads = [x for x in lines if ":" in x]
    b = decode64("".join(x for x in lines if ":" not in x))
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in heads) and any(x.startswith("DEK-Info:") for x in heads):
        return bool(b) and len(b) % 8 == 0
    if is_der_key(b) or is_ssh_key(b):
        return True
    top = der_items(b, 0, len(b)) if b else None  # PKCS#8, encrypted: an algorithm and the ciphertext
    inner = der_items(b, top[0][1], top[0][2]) if top and len(top) == 1 and top[0][0] == 0x30 else None
    return bool(inner) and [t for t, _, _ in inner] == [0x30, 0x04]


def _keys_in_run(run: str) -> list[tuple[int, int, str]]:
    """Keys ``(start, end, kind)`` in a base64 run: each place where one may begin is tried, a SEQUENCE over its own length."""
    at = None
    flat = run.rstrip("=")
    if "\n" in flat:
        at = [i for i, c in enumerate(flat) if c not in "\r\n"]
        flat = re.sub(r"[\r\n]+", "", flat)
    place = (lambda i: at[i]) if at else (lambda i: i)
    out, done = [], 0
    for m in _BEGIN.finditer(flat):
        i = m.start()
        if i < done:
            continue
        kind = None
        if m[0][0] == "M":
            n = der_size(decode64(flat[i:i + 8]) or b"")
            end = i + -(-n * 8 // 6) if n and n >= 24 else len(flat) + 1
            if end <= len(flat) and is_der_key(decode64(flat[i:end])):
                kind = "der_key"
        else:
            end = len(flat)
            head = decode64(flat[i:i + 32]) or b""
            if (head.startswith(_SSH_MAGIC) or _SSH_TYPE.match(head[4:])) and is_ssh_key(decode64(flat[i:])):
                kind = "ssh_key"
        if kind:
            done = end
            # signs that fill the run up belong to the key that ends it
            out.append((place(i), len(run) if end == len(flat) else place(end - 1) + 1, kind))
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """All findings ``(start, end, kind)`` of one text, by start, then kind as listed."""
    found = []
    if any(c in text for c in ":="):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "ey" in text and "." in text:
        for m in _DOTTED.finditer(text):
            for h in _HEADER.finditer(m[1]):
                if is_signed_token(f"{m[1][h.start():]}.{m[2]}.{m[3]}"):
                    found.append((m.start() + h.start(), m.end(), "jwt"))
                    break
    taken = [(0, 0)]
    if "-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            if _is_armoured(m[2]):
                found.append((m.start(), m.end(), "armour"))
                taken.append(m.span())
    free = lambda i: taken[bisect.bisect(taken, (i, len(text) + 1)) - 1][1] <= i
    for m in _B64.finditer(text):
        if free(m.start()):
            found += [(m.start() + a, m.start() + z, kind) for a, z, kind in _keys_in_run(m[0])]
    for m in _ANYHEX.finditer(text):
        n = der_size(bytes.fromhex(m[0][:12])) or 0
        if 24 <= n <= len(m[0]) // 2 and free(m.start()) and is_der_key(bytes.fromhex(m[0][:2 * n])):
            found.append((m.start(), m.start() + 2 * n, "der_key"))
    return sorted(found, key=lambda x: (x[0], _ORDER[x[2]], x[1]))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.arrow_udf(T.ArrayType(_SPAN))
def find_secrets(texts: pa.Array) -> pa.Array:
    """Findings of a text column as an array of ``(kind, start, end)``; NULL and empty texts have none."""
    rows = [scan(x) if x else [] for x in texts.to_pylist()]
    t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "end": z} for a, z, k in r] for r in rows], t)


@F.arrow_udf(T.StringType())
def redact(texts: pa.Array, found: pa.Array) -> pa.Array:
    """The text with every finding, overlapping ones joined, replaced by ``[secret]``. A NULL text stays NULL."""
    out = []
    for x, spans in zip(texts.to_pylist(), found.to_pylist(), strict=True):
        if x and spans:
            kept, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    kept += [x[at:s["start"]], "[secret]"]
                at = max(at, s["end"])
            x = "".join(kept) + x[at:]
        out.append(x)
    return pa.array(out, pa.string())


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``found``, all findings as an array of ``(kind, start, end)``."""
    return docs.select(F.col(id_col).alias("doc_id"), find_secrets(F.col(text_col)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The counts of the base kinds, the hash of their spans and all spans as text."""
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def span_hash(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in spans if k in KINDS[:3]).encode()).hexdigest()


def redacted(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with the findings in the text replaced and the length column set anew."""
    out = docs.withColumn(text_col, redact(F.col(text_col), find_secrets(F.col(text_col))))
    if n_chars_col and n_chars_col in docs.columns:
        was = docs.schema[n_chars_col].dataType
        out = out.withColumn(n_chars_col, F.coalesce(F.length(text_col).cast(was), F.col(n_chars_col)))
    return out.select(*docs.columns)
