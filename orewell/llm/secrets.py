"""Operator 1: secret scans with structural confirmation.

Base rules (``assign``, ``access``, ``hex``) are patterns. Beyond them, base64 and hex candidates are decoded and reported only when the
bytes have the structure of a secret: a private key in DER (every nested length adds up), an OpenSSH key file (its length-prefixed
strings fit), or a signed token whose header and claims are JSON objects and whose header names an algorithm. PEM bodies may have header lines;
an encrypted one is confirmed by its cipher's block size.

Escaped line ends (backslash n and the like) count as line ends, and lines of at least 16 characters are joined before decoding. All candidates are decoded, whatever
they begin with. DER and OpenSSH keys begin and end with a line or a candidate; PEM, tokens and further candidates are looked for in decoded
bytes too, up to NESTED levels deep. A span covers whole lines of its candidate. Lines inside a PEM span are not joined to a further span.

Defined results: a null text is an empty text, without spans. Long texts are scanned whole. Repeated rows give repeated results.
An empty table gives an empty table. Columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, runs

#: Order of kinds at equal starts: the base ones, then those that the structure confirms.
KINDS = ("assign", "access", "hex", "jwt", "der_key", "openssh_key")
BASE = KINDS[:3]
SPAN = "array<struct<kind:string,start:int,end:int>>"

_either = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
ASSIGN = re.compile(rf"""(?:{'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Escaped line ends, and a backslash that continues a line.
ESCAPE = re.compile(r"\\+(?:[nrt]|u000[adAD])|\\(?=\s*\n)")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]*\.[A-Za-z0-9_.-]*(?:[\x20\t\r]*\n\s*[A-Za-z0-9_.-]+)*|(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{16,}(?:[\x20\t\r]*\n\s*[A-Za-z0-9_.-]+)+")
B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t\r]*\n\s*[A-Za-z0-9+/_-]+)*={0,2}")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{16,}(?:[\x20\t\r]*\n\s*[0-9A-Fa-f]+)*(?![0-9A-Fa-f])")
LINE = re.compile(r"[^\s=]+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_HEADER = re.compile(r"^[\x20\t]*([A-Za-z][A-Za-z0-9-]*):[\x20\t]*([^\r\n]*)", re.M)
LEAST_64, LEAST_HEX, NESTED = 40, 64, 2


def decode64(s: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None if it isn't."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True) if len(s) % 4 != 1 else None
    except binascii.Error:
        return None


def _tlv(b: bytes, i: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value at ``i``, if tag and length are whole and the value stays inside ``end``."""
    if i + 2 > end:
        return None
    tag, n, i = b[i], b[i + 1], i + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or i + k > end or b[i] == 0:
            return None
        n, i = int.from_bytes(b[i : i + k], "big"), i + k
        if n < 0x80:
            return None
    return (tag, i, i + n) if i + n <= end else None


def _children(b: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while start < end:
        if (x := _tlv(b, start, end)) is None:
            return None
        out.append(x)
        start = x[2]
    return out


def is_der_key(b: bytes) -> bool:
    """PKCS#1, SEC 1 or PKCS#8 (plain or encrypted): one outer sequence of exactly all bytes whose parts nest without a gap."""
    top = _tlv(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return False
    parts = _children(b, top[1], top[2])
    if not parts:
        return False
    tags, small = [t for t, _, _ in parts], lambda p: p[0] == 2 and p[2] - p[1] == 1 and b[p[1]]
    if len(parts) >= 9 and set(tags[:9]) == {2}:  # version and eight numbers of an RSA key
        return small(parts[0]) in (0, 1) and parts[1][2] - parts[1][1] >= 32
    if tags[:2] == [2, 4] and small(parts[0]) == 1:  # version 1 and an elliptic-curve key
        return parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) and _children(b, s, e) for t, s, e in parts[2:])
    if tags[:3] == [2, 0x30, 4] and small(parts[0]) in (0, 1):  # version, algorithm, wrapped key
        inner = _children(b, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 6 and parts[2][2] - parts[2][1] >= 16
    if tags == [0x30, 4]:  # algorithm with parameters, encrypted key
        inner = _children(b, parts[0][1], parts[0][2])
        return bool(inner) and len(inner) == 2 and inner[0][0] == 6 and inner[1][0] == 0x30 and (parts[1][2] - parts[1][1]) >= 32
    return False


def openssh_end(b: bytes) -> int | None:
    """Where an OpenSSH key ends: the magic, cipher, derivation and its options, a key count, and as many public keys and a private part."""
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic):
        return None
    i, held = len(magic), []

    def string() -> bytes | None:
        nonlocal i
        n = int.from_bytes(b[i : i + 4], "big")
        if i + 4 + n > len(b) or i + 4 > len(b):
            return None
        i += 4 + n
        return b[i - n : i]

    for _ in range(3):
        held.append(string())
        if held[-1] is None:
            return None
    count = int.from_bytes(b[i : i + 4], "big")
    i += 4
    if not 1 <= count <= 16 or not held[0]:
        return None
    return i if all(string() for _ in range(count + 1)) else None


def is_openssh_key(b: bytes) -> bool:
    return openssh_end(b) == len(b)


def is_token(s: str) -> bool:
    """A signed token: header and claims decode to JSON objects, the header names an algorithm other than none, and there is a signature."""
    head, claims, signature = s.split(".")
    for part in (head, claims):
        raw = decode64(part)
        try:
            obj = json.loads(raw) if raw else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(obj, dict) or (part is head and not isinstance(obj.get("alg"), str)):
            return False
    return bool(signature) and json.loads(decode64(head))["alg"].lower() != "none"


def _kind_of(b: bytes | None) -> str | None:
    if not b:
        return None
    return "der_key" if is_der_key(b) else "openssh_key" if is_openssh_key(b) else None


def pem_keys(text: str) -> list[tuple[str, int, int]]:
    """Private keys in PEM armour; a body may begin with header lines."""
    out = []
    for m in PEM.finditer(text):
        e = text.find("-----", m.end())
        if not text.startswith(last := f"-----END {m[1]}-----", e):
            continue
        body = text[m.end() : e]
        heads = {h[1].lower(): h[2].strip() for h in PEM_HEADER.finditer(body)}
        raw = decode64(re.sub(r"\s", "", PEM_HEADER.sub("", body)))
        kind = _kind_of(raw)
        if raw and not kind and "ENCRYPTED" in heads.get("proc-type", ""):
            cipher, _, iv = heads.get("dek-info", "").partition(",")
            block = 16 if re.match("AES|CAMELLIA|ARIA|SEED", cipher) else 8
            if re.fullmatch(f"[0-9A-Fa-f]{{{2 * block}}}", iv.strip()) and len(raw) >= 32 and len(raw) % block == 0:
                kind = "der_key"
        if kind:
            out.append((kind, m.start(), e + len(last)))
    return out


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens, on one line or wrapped; a wrapped signature goes on while lines are as long as the token's first."""
    out = []
    for m in DOTTED.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, *m.span())]
        joint = "".join(text[s:e] for s, e in lines)
        if joint.count(".") < 2:
            continue
        begin = [0]
        for s, e in lines:
            begin.append(begin[-1] + e - s)
        dots = [-1, *(i for i, c in enumerate(joint) if c == "."), len(joint)]
        for k in range(1, len(dots) - 2):
            head, claims, tail = dots[k - 1] + 1, dots[k] + 1, dots[k + 1]
            if not (decode64(joint[claims:tail]) or b"").lstrip().startswith(b"{"):
                continue
            low, high = bisect_right(begin, head), bisect_right(begin, dots[k])
            for at in (head, *begin[low:high]):  # the line before may end in a word
                row, last = bisect_right(begin, at) - 1, bisect_right(begin, tail) - 1
                if row < last:
                    width = max(b - a for a, b in zip(begin[row : last + 1], begin[row + 1 : last + 2], strict=True))
                    last = min(bisect_right(begin, tail + 1), len(lines)) - 1
                    while last + 1 < len(lines) and begin[last + 1] - begin[last] >= width:
                        last += 1
                end = min(begin[last + 1], dots[k + 2])
                if is_token(joint[at:end]):
                    last = bisect_right(begin, end - 1) - 1
                    out.append(("jwt", lines[row][0] + at - begin[row], lines[last][0] + end - begin[last]))
                    break
    return out


def decoded(text: str, m: re.Match, bits: int, depth: int) -> list[tuple[str, int, int]]:
    """Keys and tokens in the bytes of one candidate, whose characters hold ``bits`` bits each."""
    lines = [x.span() for x in LINE.finditer(text, *m.span())]
    joint = "".join(text[s:e] for s, e in lines)
    if len(joint) < (LEAST_HEX if bits == 4 else LEAST_64):
        return []
    begin = [0]
    for s, e in lines:
        begin.append(begin[-1] + e - s)
    places, out, seen = {x: i for i, x in enumerate(begin)}, [], set()

    def raw_of(a: int, b: int) -> bytes | None:
        return bytes.fromhex(joint[a : b - (b - a) % 2]) if bits == 4 else decode64(joint[a : b - ((b - a) % 4 == 1)])

    def found(kind: str, a: int, b: int) -> None:
        i, j = bisect_right(begin, a) - 1, bisect_right(begin, b - 1) - 1
        out.append((kind, lines[i][0], m.end() if j == len(lines) - 1 else lines[j][1]))

    for i, a in enumerate(begin[:-1]):
        head = raw_of(a, min(a + 24, begin[-1])) or b""
        size = None
        if head[:1] == b"\x30" and len(head) >= 6 and (top := _tlv(head, 0, 1 << 40)):
            size = top[2]
        elif head.startswith(b"openssh-key-v1\0"[: len(head)]) and len(head) >= 12:
            size = openssh_end(raw_of(a, begin[-1]) or b"")
        chars = -(-8 * size // bits) if size else 0
        if chars >= (LEAST_HEX if bits == 4 else LEAST_64) and a + chars in places and (kind := _kind_of(raw_of(a, a + chars))):
            found(kind, a, a + chars)
    if depth < NESTED:
        for a in begin[:-1]:
            shift = a * bits % 8 if bits == 4 else a % 4
            if shift in seen:
                continue
            seen.add(shift)
            raw = raw_of(a, begin[-1])
            if raw:
                for kind, s, e in structures(raw.decode("latin-1"), depth + 1):
                    found(kind, a + s * 8 // bits, a - (-e * 8 // bits))
    return out


def structures(text: str, depth: int = 0) -> set[tuple[str, int, int]]:
    """The spans that a structure confirms."""
    if "\\" in text:
        text = ESCAPE.sub(lambda x: "\n" * len(x[0]), text)  # of the same length: places stay
    out, armour = set(), []
    if "PRIVATE KEY-----" in text:
        armour = pem_keys(text)
        out.update(armour)
    if "." in text:
        out.update(tokens(text))
    for pattern, bits in ((B64, 6), (HEX_ANY, 4)):
        for m in pattern.finditer(text):
            inside = any(s <= m.start() and m.end() <= e for _, s, e in armour)
            if not inside or "\n" not in m[0]:
                out.update(decoded(text, m, bits, depth))
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end), in code points, by start and then kind."""
    if not text:
        return []
    out: set[tuple[int, int, int]] = set()
    if ":" in text or "=" in text:
        out.update((0, *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6)
    if "AKIA" in text:
        out.update((1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20)
    out.update((2, *m.span()) for m in HEX.finditer(text))
    out.update((KINDS.index(k), s, e) for k, s, e in structures(text))
    return [(KINDS[k], s, e) for s, k, e in sorted((s, k, e) for k, s, e in out)]


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each input row: the key and ``spans``, all spans by start and then kind."""

    def make():
        return lambda keys, texts: {key: keys, "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(x)] for x in texts]}

    return map_text(docs, make, f"{key} {docs.schema[key].dataType.simpleString()}, spans {SPAN}", key, text)


def redact(text: str | None) -> str | None:
    """The text with each stretch of overlapping spans replaced by the kind that begins it."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[secret:{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets masked in ``text``; ``length``, if there, follows. No row is dropped; null stays null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names, kinds = docs.columns, dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(names.index(text))), 0).to_pylist()
            for i, j in runs(sizes):  # a bounded number of characters at a time, or one text
                b = batch.slice(i, j - i)
                old = b.column(names.index(text)).to_pylist()
                new = [redact(x) for x in old]
                cols = list(b.columns)
                cols[names.index(text)] = pa.array(new, pa.string())
                if length in names:
                    at = names.index(length)
                    same = b.column(at).to_pylist()
                    cols[at] = pa.array([s if x == y else len(y) for s, x, y in zip(same, old, new, strict=True)], b.column(at).type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    assert kinds[text] == "string"
    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of ``kinds``, comma-joined in their order."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's digest columns for each document, and the number of spans of each confirmed kind."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("spans"), BASE), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[n(k).alias(f"n_{k}") for k in KINDS[3:]],
    )
