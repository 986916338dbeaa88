"""Secrets in texts: an Aho-Corasick keyword prefilter, anchored expressions near its hits, then embedded checksums.

Spans are in code points, end exclusive. Kinds, in the order in which equal starts are listed: assign, access, hex
(the base, always found), then github, npm, jwt, pem, slack, google, stripe. A match of github or npm counts only if its
embedded CRC-32 is right, of jwt only if its header decodes to JSON with "alg". hex has no keyword; its runs are found by
one scan. Texts of any length are scanned whole, in time linear in their length. Null and empty texts have no spans. Rows are independent: repeated rows and ids give repeated results; columns
of the input named as results are replaced; an empty table gives an empty result. Map-only: no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import slices, table

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "slack", "google", "stripe")
_KEYS = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
#: Anchored at a keyword's start. Group 1 is what has a least length or a checksum.
_AT = {
    "assign": re.compile(_KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"(AKIA[A-Z0-9]+)"),
    "github": re.compile(r"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
    "pem": re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)"),
    "slack": re.compile(r"(xox[abeprs]-[A-Za-z0-9-]{20,})"),
    "google": re.compile(r"(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"),
    "stripe": re.compile(r"((?:sk|rk)_live_[A-Za-z0-9]{20,})"),
}
_LEAST = {"assign": 6, "access": 20}
#: Keyword (lower case) to kind.
_WORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin": "pem",
    "xox": "slack", "aiza": "google", "sk_live_": "stripe", "rk_live_": "stripe",
}
_RUN = re.compile(r"[A-Za-z0-9_-]*")
_HEX = re.compile(r"[0-9a-f]{24,}")
_FOLD = {c: c + 32 for c in range(65, 91)}  # A-Z only, so that places stay
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """The six characters that github and npm tokens end with."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0")


def _valid(kind: str, value: str) -> bool:
    if kind in ("github", "npm"):
        body = value.split("_", 1)[1]
        return crc_base62(body[:-6]) == body[-6:]
    if kind == "jwt":
        head = value.split(".")[0]
        try:
            found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, binascii.Error):
            return False
        return isinstance(found, dict) and "alg" in found
    return len(value) >= _LEAST.get(kind, 0)


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in _WORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def spans_of(text: str | None, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and without overlaps within a kind, by start and then kind as listed."""
    if not text:
        return []
    hits: dict[str, set[int]] = {}
    for end, (n, kind) in automaton.iter(text.translate(_FOLD)):
        hits.setdefault(kind, set()).add(end + 1 - n)
    out = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    for kind, starts in hits.items():
        over = 0
        for at in sorted(starts):
            if at < over:
                continue
            if m := _AT[kind].match(text, at):
                over = m.end()
                if _valid(kind, m[1]):
                    out.append((at, over, kind))
            elif kind == "jwt":  # a later start in the same run fails as this one does
                over = _RUN.match(text, at).end()
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, or run of overlapping spans, becomes [kind] of the first."""
    out, at, over = [], 0, -1
    for start, end, kind in spans:
        if start >= over:
            out += [text[at:start], f"[{kind}]"]
            at = over = end
        else:
            at = over = max(over, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, text: str = "text", replace: bool = False) -> DataFrame:
    """docs with secret_spans: array of (start, end, kind); with replace, text has its spans replaced too."""
    fields = [f for f in docs.schema.fields if f.name != "secret_spans"]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    schema = T.StructType([*fields, T.StructField("secret_spans", T.ArrayType(span))])
    names = [f.name for f in fields]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = _automaton()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for part in slices(batch):
                texts = part.column(names.index(text)).to_pylist()
                found = [spans_of(t, automaton) for t in texts]
                columns = list(part.columns)
                if replace:
                    columns[names.index(text)] = pa.array([redact(t, s) if s else t for t, s in zip(texts, found, strict=True)], columns[names.index(text)].type)
                rows = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*names, "secret_spans"])

    return docs.select(*names).mapInArrow(scan, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secret_spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The contract's base by plain expressions over the whole text, for tests."""
    t = text or ""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(_AT["assign"].pattern, t) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    n = [sum(s[2] == k for s in found) for k in KINDS[:3]]
    return *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in found).encode()).hexdigest()


QUERIES = {"op10_secret_scan": op10_secret_scan}
SQL: dict[str, str] = {}
