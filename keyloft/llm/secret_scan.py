"""Secret scans: an Aho-Corasick keyword prefilter, expressions anchored at the
hits only, then checks of embedded checksums.

One automaton pass over a text finds every keyword of every kind.  Texts
without a hit cost nothing more; at a hit the kind's expression is matched from
that place and nowhere else.  Runs of hexadecimal digits have no keyword; their
prefilter maps the text to digit or not and looks for 32 digits in a row.

Kinds, in their order at equal starts.  The first three are the base kinds.

``assign``   a password, passwd, secret, token or api key that is set to a value
``access``   a cloud access key id, ``AKIA`` and capitals or digits
``hex``      32 or more hexadecimal digits
``github``   a token with prefix and six checksum characters (CRC-32, base 62)
``npm``      the same layout with another prefix
``slack``    ``xox`` tokens
``stripe``   live secret keys
``google``   API keys that begin ``AIza``
``jwt``      three base64url parts whose header decodes to JSON with ``alg``
``pem``      a private key, from its opening line to its END line or, where that is
             missing, over the base64 lines that follow
``card``     13 to 19 digits, said to be a card, with a right Luhn sum
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import FOLD, raw_texts, release_memory

#: The kinds in their order at equal starts.
KINDS = ["assign", "access", "hex", "github", "npm", "slack", "stripe", "google", "jwt", "pem", "card"]
BASE = ["assign", "access", "hex"]

#: Lower-case keywords and the kind each one opens.
KEYWORDS = [
    ("password", "assign"),
    ("passwd", "assign"),
    ("secret", "assign"),
    ("token", "assign"),
    ("apikey", "assign"),
    ("api_key", "assign"),
    ("akia", "access"),
    ("ghp_", "github"),
    ("gho_", "github"),
    ("ghu_", "github"),
    ("ghs_", "github"),
    ("ghr_", "github"),
    ("npm_", "npm"),
    ("xoxb-", "slack"),
    ("xoxp-", "slack"),
    ("xoxa-", "slack"),
    ("sk_live_", "stripe"),
    ("rk_live_", "stripe"),
    ("aiza", "google"),
    ("eyj", "jwt"),
    ("-----begin", "pem"),
    ("card", "card"),
]

#: The expression of each kind, matched at a keyword's first byte.
#: They run on bytes; all that they can match is ASCII.
PATTERNS = {
    "assign": re.compile(
        rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "slack": re.compile(rb"xox[bpa]-[0-9]{8,}-[0-9A-Za-z-]{8,}"),
    "stripe": re.compile(rb"[sr]k_live_[0-9A-Za-z]{16,}"),
    "google": re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "jwt": re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    "card": re.compile(rb"(?i:card)[ a-z]{0,16}[:#=]?\x20*([0-9](?:[ -]?[0-9]){12,18})(?![0-9])"),
}
KEY_END = re.compile(rb"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
#: Header lines and base64 lines of a key without an END line; the last may be short.
#: Between lines stand white space, quotes, marks of comments, or line breaks as they are escaped.
KEY_BODY = re.compile(
    rb"""(?:(?:[\s"'`,;+>#*|]|\\[nrt])*+[A-Za-z][A-Za-z0-9-]{0,40}:\x20(?:[^\r\n\\]|\\(?![nr]))*+)*+"""
    rb"""(?:(?:[\s"'`,;+>#*|]|\\[nrt])*+[A-Za-z0-9+/=]{16,}+)++"""
    rb"""(?:(?:[\s"'`,;+>#*|]|\\[nrt])++[A-Za-z0-9+/=]{1,15}+(?=["'`]|[,;]*(?:[\r\n]|\\[nr]|\Z)))?"""
)
HEX_RUN = re.compile(rb"[0-9a-f]+")
HEX_CLASS = bytes(104 if 48 <= b <= 57 or 97 <= b <= 102 else 46 for b in range(256))
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six base-62 characters."""
    n, out = binascii.crc32(body), bytearray()
    for _ in range(6):
        n, r = divmod(n, 62)
        out.append(BASE62[r])
    return bytes(reversed(out))


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed([d - 48 for d in digits if 48 <= d <= 57])):
        total += c if i % 2 == 0 else (2 * c if c < 5 else 2 * c - 9)
    return total % 10 == 0


def _jwt(token: bytes) -> bool:
    head = token.split(b".", 1)[0]
    try:
        said = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(said, dict) and "alg" in said


def _key_end(raw: bytes, at: int) -> int:
    """Where the private key ends whose opening line ends at ``at``."""
    following = raw.find(b"-----BEGIN", at)
    if m := KEY_END.search(raw, at, following if following >= 0 else len(raw)):
        return m.end()
    m = KEY_BODY.match(raw, at)
    return m.end() if m else at


def _holds(kind: str, m: re.Match) -> bool:
    """Lengths and checksums that a match must pass."""
    text = m.group()
    if kind == "assign":
        return len(m.group(1)) >= 8
    if kind == "access":
        return len(text) >= 16
    if kind in ("github", "npm"):
        return crc_base62(text[4:-6]) == text[-6:]
    if kind == "jwt":
        return _jwt(text)
    if kind == "card":
        return luhn(m.group(1))
    return True


class Scanner:
    """Finds the spans of one text after the other."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS:
            self.automaton.add_word(word, (len(word), kind))
        self.automaton.make_automaton()

    def spans(self, raw: bytes) -> list[tuple[int, int, str]]:
        """Byte spans ``(start, end, kind)`` by start, then kind as listed."""
        found: list[tuple[int, int, str]] = []
        hits: dict[str, list[int]] = {}
        for end, (size, kind) in self.automaton.iter(raw.translate(FOLD).decode("latin-1")):
            hits.setdefault(kind, []).append(end - size + 1)
        for kind, starts in hits.items():
            past = 0
            for at in sorted(starts):  # leftmost first; a match bars starts inside it
                if at >= past and (m := PATTERNS[kind].match(raw, at)):
                    past = _key_end(raw, m.end()) if kind == "pem" else m.end()
                    if _holds(kind, m):
                        lo = m.start(1) if kind == "card" else at
                        found.append((lo, past, kind))
        digits = raw.translate(HEX_CLASS)
        at = digits.find(b"h" * 32)
        while at >= 0:
            end = HEX_RUN.match(raw, at).end()
            found.append((at, end, "hex"))
            at = digits.find(b"h" * 32, end)
        found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        return found


def _code_points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same spans counted in code points."""
    if not spans or raw.isascii():
        return spans
    at = {0: 0}
    last = count = 0
    for p in sorted({p for s in spans for p in s[:2]}):
        count += len(raw[last:p].decode("utf-8", "replace"))
        at[p], last = count, p
    return [(at[a], at[b], k) for a, b, k in spans]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, *, text_col: str = "text", redact: str | None = None) -> DataFrame:
    """``docs`` with what was found in each whole text.

    Adds ``secret_spans`` (array of start, end, kind in code points, end
    exclusive; by start, then kind as listed).  With ``redact``, the text column
    is replaced: every span, overlapping ones joined, becomes that string.

    A null text counts as empty and stays null; all other columns and all rows,
    repeated ones too, are kept as they are.  A column that already carries the
    added name is replaced.  Very long texts are scanned whole, in one pass.  An empty
    table gives an empty result.
    """
    base = docs.drop("secret_spans")
    schema = base.schema
    names = base.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            texts, spans, changed = raw_texts(batch.column(place)), [], False
            for i, raw in enumerate(texts):
                own = scanner.spans(raw) if raw else []
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in _code_points(raw or b"", own)])
                if own and redact is not None:
                    texts[i], changed = _redacted(raw, own, redact.encode()), True
            columns = list(batch.columns)
            if changed:
                columns[place] = pa.array(texts, pa.binary()).cast(columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind_of)], [*names, "secret_spans"])
            release_memory()

    span = StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", StringType())
    return base.mapInArrow(run, StructType([*schema.fields, StructField("secret_spans", ArrayType(span))]))


def _redacted(raw: bytes, spans: list[tuple[int, int, str]], by: bytes) -> bytes:
    out, past = [], 0
    lo = hi = None
    for a, b, _ in [*spans, (len(raw) + 1, len(raw) + 1, "")]:
        if lo is not None and a >= hi:
            out += [raw[past:lo], by]
            past, lo = hi, None
        if a <= len(raw):
            lo, hi = (a, b) if lo is None else (lo, max(hi, b))
    return b"".join([*out, raw[past:]])


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and joined spans of each row of :func:`scan_secrets`."""

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secret_spans", lambda s: s["kind"].isin(BASE))
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
