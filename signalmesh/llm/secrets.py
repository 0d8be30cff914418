"""Secret scan: an Aho-Corasick keyword prefilter, anchored regular expressions near hits, checksums.

One pass of the automaton over the folded bytes of a text finds every keyword; only there a regular expression
is matched, anchored at the hit. Runs of hex digits have no keyword: their prefilter is a vectorised search for
aligned blocks of hex digits, around which the run is measured. Token formats that embed a checksum are
reported only where it holds. Offsets are code points, end exclusive.

Kinds in order: assign, access, hex (the base kinds, each leftmost and without overlap, too short ones dropped after
matching), then github and npm tokens (the last six base-62 digits are the CRC-32 of the 30 before), and jwt (three
base64url parts whose first decodes to a JSON object with `alg`).

Defined cases: null and empty texts have no spans; spans of different kinds may overlap, and those that start together are ordered by kind;
a very long text is scanned whole, in memory of a few times its size; repeated rows and ids are scanned row by row; a null id stays
null; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
#: Folded keyword: kind. Fixed values of the formats.
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4, "eyj": 5}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = np.zeros(256, bool)
_IS_HEX[48:58] = _IS_HEX[97:103] = True


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, k = divmod(n, 62)
        out = DIGITS[k] + out
    return out.rjust(width, "0")


def _checked(m: re.Match) -> bool:
    return base62(zlib.crc32(m[1])).encode() == m[2]


def _is_jwt(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested beyond any token header
        return False
    return isinstance(head, dict) and "alg" in head


_RULES = {0: (ASSIGN, lambda m: len(m[1]) >= MIN_ASSIGN), 1: (ACCESS, lambda m: len(m[0]) >= MIN_ACCESS), 3: (GITHUB, _checked), 4: (NPM, _checked), 5: (JWT, _is_jwt)}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _hex_runs(raw: bytes) -> list[tuple[int, int]]:
    """Maximal runs of at least MIN_HEX hex digits: each covers an aligned block of half that size."""
    half = MIN_HEX // 2
    is_hex = _IS_HEX[np.frombuffer(raw, np.uint8)[: len(raw) // half * half]].reshape(-1, half)
    out, last = [], 0
    for block in np.flatnonzero(is_hex.all(1)).tolist():
        at = block * half
        if at < last:
            continue
        first = at
        while first > last and _IS_HEX[raw[first - 1]]:
            first -= 1
        last = HEX.match(raw, first).end()
        if last - first >= MIN_HEX:
            out.append((first, last))
    return out


def find_spans(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and kind."""
    raw = text.encode()
    found = [(a, 2, b) for a, b in _hex_runs(raw)]
    past = dict.fromkeys(_RULES, 0)
    hits = sorted((at - n + 1, kind) for at, (kind, n) in keywords.iter(raw.lower().decode("latin-1")))
    for start, kind in hits:
        rule, valid = _RULES[kind]
        if start >= past[kind] and (m := rule.match(raw, start)):
            past[kind] = m.end()
            if valid(m):
                found.append((start, kind, m.end()))
    if len(raw) != len(text):
        edges = sorted({x for a, _, b in found for x in (a, b)})
        point, last, n = {}, 0, 0
        for e in edges:
            n += len(raw[last:e].decode())
            point[e] = n
            last = e
        found = [(point[a], kind, point[b]) for a, kind, b in found]
    return sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (array of struct of kind, start, end; by start, then kind in listed order) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t, keywords)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [id_col, "spans"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
