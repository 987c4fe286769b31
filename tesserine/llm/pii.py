"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

    kind        base  confirmed by                           else
    email       0.8   -                                      -
    card        0.3   Luhn: +0.5                             -0.3
    iban        0.3   mod 97: +0.6                           -0.3
    ip          0.6   four numbers up to 255                 no span
    phone       0.6   7 to 15 digits                         no span
    ssn         0.4   no area 000, 666 or 9xx: +0.1          no span
    secret      0.7   at least 8 different characters: +0.2  -0.4

Cards: in a run of digits, one blank or hyphen between any two, every stretch
of 13 to 19 digits that begins and ends where the run is parted is tried; of
those that Luhn confirms and that overlap, the longest stays, then the first.
So a card is found beside other numbers.

One of a kind's context words within 40 characters before or after adds 0.2; a
span counts from a score of `threshold` on. Of spans that overlap the one with
the higher score stays, then the longer, then the earlier.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

NEAR = 40
PATTERNS: dict[str, tuple[re.Pattern, float, re.Pattern]] = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z])"), 0.8, re.compile(r"e-?mail|contact|write to|courriel|correo", re.I)),
    "card": (re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"), 0.3, re.compile(r"card|visa|mastercard|credit|debit|carte|karte|tarjeta", re.I)),
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0.3, re.compile(r"iban|account|bank|konto|compte|cuenta", re.I)),
    "ip": (re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), 0.6, re.compile(r"\bip\b|address|host|server", re.I)),
    "phone": (re.compile(r"(?<![\w+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d]|[.-]\d)"), 0.6, re.compile(r"phone|call|tel\b|tél|fax|mobile|telefon|whatsapp", re.I)),
    "ssn": (re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0.4, re.compile(r"ssn|social security|\bss\b", re.I)),
    "secret": (re.compile(r"""\b(?:[A-Za-z0-9]+[_-])*(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key)\b["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9+/_=.-]{12,512})|\bAKIA[0-9A-Z]{16}\b""", re.I), 0.7, re.compile(r"key|secret|auth|login|credential", re.I)),
}
RUN = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,}")
#: A text without any of these has no span of any kind; RE2 finds them at once.
HINT = r"@[A-Za-z0-9-]|\p{Nd}[ .()-]{0,2}\p{Nd}[ .()-]{0,2}\p{Nd}|[A-Z]{2}\p{Nd}{2} ?[A-Z0-9]{4}|(?i:token|secret|passw|key|akia)"
SPAN = "struct<kind:string,begin:int,length:int,score:double,confirmed:boolean>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0 and len(set(digits)) > 1


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def cards(text: str) -> list[tuple[int, int]]:
    """Begin and end of the stretches that Luhn confirms."""
    out = []
    for run in RUN.finditer(text):
        parts = [(m.start(), m.end()) for m in re.compile(r"\d+").finditer(text, *run.span())]
        found = []
        for i, (a, _) in enumerate(parts):
            digits = ""
            for j in range(i, len(parts)):
                digits += text[parts[j][0] : parts[j][1]]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and luhn(digits):
                    found.append((a - parts[j][1], i, j))
        taken = [False] * len(parts)
        for _, i, j in sorted(found):
            if not any(taken[i : j + 1]):
                taken[i : j + 1] = [True] * (j + 1 - i)
                out.append((parts[i][0], parts[j][1]))
    return sorted(out)


def judge(kind: str, m: re.Match) -> tuple[float, bool] | None:
    """What the validator adds to the score, and whether it confirms; None: no span."""
    s = m.group()
    digits = re.sub(r"\D", "", s)
    if kind == "card":
        return -0.3, False  # cards() has the confirmed ones
    if kind == "iban":
        s = s.replace(" ", "")
        return (0.6, True) if 15 <= len(s) <= 34 and mod97(s) else (-0.3, False)
    if kind == "ip":
        return (0.0, True) if all(int(x) < 256 and (len(x) == 1 or x[0] != "0") for x in s.split(".")) else None
    if kind == "phone":
        return (0.0, True) if 7 <= len(digits) <= 15 else None
    if kind == "ssn":
        return (0.1, True) if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else None
    if kind == "secret":
        return (0.2, True) if len(set(m.group(m.lastindex or 0))) >= 8 else (-0.4, False)
    return 0.0, True


def find(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, float, bool]]:
    """kind, begin, length (in characters), score and whether confirmed, of the spans in a text, in their order."""
    found = []
    for kind, (pattern, base, context) in PATTERNS.items():
        if kind == "email" and "@" not in text:
            continue
        matches = [(m.span(), m.span(m.lastindex or 0) if kind == "secret" else m.span(), judge(kind, m)) for m in pattern.finditer(text)]
        if kind == "card":
            matches += [(x, x, (0.5, True)) for x in cards(text)]
        for (begin, end), (a, b), verdict in matches:
            if verdict is None:
                continue
            near = context.search(text[max(0, begin - NEAR) : begin]) or context.search(text[end : end + NEAR])
            score = round(min(1.0, max(0.0, base + verdict[0] + 0.2 * bool(near))), 2)
            if score >= threshold:
                found.append((kind, a, b - a, score, verdict[1]))
    found.sort(key=lambda x: (-x[3], -x[2], x[1], x[0]))
    out: list[tuple[str, int, int, float, bool]] = []
    begins: list[int] = []
    ends: list[int] = []  # of the spans in out, in their order in the text
    for x in found:
        k = bisect_right(begins, x[1])
        if (k == 0 or ends[k - 1] <= x[1]) and (k == len(begins) or x[1] + x[2] <= begins[k]):
            out.append(x)
            begins.insert(k, x[1])
            ends.insert(k, x[1] + x[2])
    return sorted(out, key=lambda x: x[1])


def masked(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, n, _, _ in spans:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = a + n
    return "".join([*out, text[at:]])


def hinted(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False))


def spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for each span: doc_id, kind, begin and length in characters, score, confirmed, and value, the span itself.

    Null and empty texts have no spans. Very long texts are searched whole.
    Of overlapping spans with tied scores and lengths the earlier stays. Digits
    are those of any script. Null doc_id: the spans have a null
    doc_id. Repeated rows give their spans each. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """

    def run(batches):
        for b in kit.slices(batches):
            texts, row, found, value = b.column("text"), [], [], []
            for k in hinted(texts).tolist():
                text = texts[k].as_py()
                for x in find(text, threshold):
                    row.append(k)
                    found.append(x)
                    value.append(text[x[1] : x[1] + x[2]])
            cols = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()), strict=True)), pa.array(value, pa.string())], ["doc_id", "kind", "begin", "length", "score", "confirmed", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kit.batchwise(run), "doc_id long, kind string, begin int, length int, score double, confirmed boolean, value string")


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, every row and column, with the spans in text masked and n_chars, where there is one, set to the new length of those texts.

    Null and empty texts and texts without spans stay as they are, whatever
    their doc_id; very long ones are masked throughout; overlapping spans as in
    spans(). Repeated rows stay. An empty table gives no rows.
    """
    schema = docs.schema
    counted = {f.name: f.dataType for f in schema.fields}.get("n_chars")

    def run(batches):
        for b in kit.slices(batches):
            at = b.schema.names.index("text")
            texts = pc.cast(b.column(at), pa.string())
            changed = {}
            for k in hinted(texts).tolist():
                text = texts[k].as_py()
                if found := find(text, threshold):
                    changed[k] = masked(text, found)
            if changed:
                rows = np.zeros(b.num_rows, bool)
                rows[list(changed)] = True
                put = lambda col, new: pc.replace_with_mask(col, pa.array(rows), new)
                b = b.set_column(at, b.schema.field(at), pc.cast(put(texts, pa.array([changed[k] for k in sorted(changed)], pa.string())), b.schema.field(at).type))
                if counted is not None and counted.typeName() in ("long", "integer"):
                    c = b.schema.names.index("n_chars")
                    b = b.set_column(c, b.schema.field(c), put(b.column(c), pa.array([len(changed[k]) for k in sorted(changed)], b.schema.field(c).type)))
            yield b

    return docs.mapInArrow(kit.batchwise(run), schema)
