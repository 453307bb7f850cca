"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust their score.

Base kinds (email, ip, card, phone) are reported whenever their own rule holds; further kinds (iban by mod-97, ssn by context) are
added when their score reaches KEEP. Offsets count code points, ends exclusive.

Rules for odd input: a null or empty text has no spans; spans of different kinds may overlap; repeated rows are scanned alike; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied

BASE = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b")
SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
ANY_DIGIT = re.compile(r"[0-9]")
#: Score before context, and the least score that an added span needs.
START = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
KEEP, NEAR, LIFT, DROP = 0.5, 40, 0.2, 0.3
#: Words that raise or lower a span's score when they stand near it.
RAISE = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|payment|credit", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax", re.I),
    "iban": re.compile(r"iban|bank|account|konto", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
}
LOWER = re.compile(r"version|example|test|isbn|serial|order", re.I)
MOD97 = {c: str(i) for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(code: str) -> bool:
    """The check of ISO 13616 account numbers."""
    return int("".join(MOD97[c] for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str):
    """Leftmost, non-overlapping. Works from each @ outwards, as only a run that ends at an @ can begin a match."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if ANY_DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return min(1.0, max(0.0, START[kind] + LIFT * bool(RAISE[kind].search(near)) - DROP * bool(LOWER.search(near))))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), by kind as listed, then start."""
    text = text or ""
    spans = [(k, a, b, score(text, k, a, b)) for k, a, b in base_spans(text)]
    if ANY_DIGIT.search(text):
        for kind, pattern, holds in (("iban", IBAN, lambda s: 15 <= len(c := s.replace(" ", "")) <= 34 and mod97(c)), ("ssn", SSN, lambda s: True)):
            for m in pattern.finditer(text):
                if holds(m[0]) and (v := score(text, kind, *m.span())) >= KEEP:
                    spans.append((kind, *m.span(), v))
    return spans


def _scan(batches):
    import pyarrow as pa

    for b in batches:
        ids, texts = b.column(0), b.column(1)
        found = [find(t.as_py()) for t in texts]
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found]
        yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kinds)], ["doc_id", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and all spans found: array of (kind, start, end, score). No shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_scan), "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>")


def digest(found) -> tuple:
    said = [f"{s['kind']}:{s['start']}:{s['end']}" for s in found]
    base = [x for x, s in zip(said, found, strict=True) if s["kind"] in BASE]
    counts = [sum(s["kind"] == k for s in found) for k in BASE]
    return (*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said))


def _digests(batches):
    import pyarrow as pa

    kinds = [*[pa.int64()] * 4, pa.string(), pa.string()]
    for b in batches:
        rows = [digest(f or []) for f in b.column(1).to_pylist()]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).mapInArrow(tidied(_digests), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
