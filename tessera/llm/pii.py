"""Personal data in text, also when it is disguised, with offsets into the source.

A text goes through normalising transducers: look-alike letters (homoglyphs) and compatibility
forms become ASCII, invisible characters vanish, runs of spelled digits become digits, and
disguises of `@` and `.` become those signs. Each edit keeps the source range it replaced, so a
span found in the normalised text is mapped back to source characters. Spans of the untouched
text ("base" spans) always stay; the transducers only add spans that overlap none of their kind.

Kinds: email, ip, card (14 to 19 digits that pass Luhn), phone (+ and 10 to 15 digits).

Defined results: a null or empty text has no spans; rows come out once for each row that went in,
repeated rows repeated; an empty table gives an empty table; only the id and text columns are read,
so other columns, whatever their names, do no harm. All matchers are linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.kernel import small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "Ѕ": "S", "І": "I", "Ј": "J",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "α": "a", "ρ": "p",
    "υ": "u", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "։": ":", "‐": "-", "‑": "-", "‒": "-", "–": "-",
    "−": "-", "。": ".", "｡": ".", "․": ".", "٠": "0", "·": ".",
}
_INVISIBLE = "­​‌‍⁠﻿"
# The digits' names.
_DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGIT_OF = {w: str(d) for names in _DIGIT_NAMES.values() for d, w in enumerate(names.split())} | {"oh": "0"}
_FOREIGN = re.compile("[^\x00-¬®-İĲ-ɏ]|­|·")
_NAME = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_SPELLED = re.compile(
    rf"(?<!\w)(?:plus[\s-]+)?(?:{_NAME})(?:(?:[\s,-]+|\s*(?:\bdot\b|\bpoint\b|\.)\s*)(?:{_NAME}|[0-9]+)(?!\w)){{2,}}", re.I
)
_SEPARATORS = re.compile(r"[,.+()\[\]-]+")
_LATIN_FORMS = frozenset(c for c in map(chr, range(0x80, 0x100)) if _FOREIGN.match(c))
_SPELLED_PART = re.compile(rf"(plus)|({_NAME})|([0-9]+)|(dot|point|\.)", re.I)
#: Marks are searched from their bracket or underscore; the white space around them is added afterwards, so no blank is scanned twice.
_AT_MARK = re.compile(r"[\[({<]\s*+(?:at|arroba|@)\s*+[\])}>]|(?<=\s)_at_(?=\s)", re.I)
_DOT_MARK = re.compile(r"[\[({<]\s*+(?:dot|punkt|point|punto|\.)\s*+[\])}>]", re.I)
#: Bare words count as a disguise only together: name at host dot ... dot a well-known ending. The host is searched from " at ",
#: the name backwards from there.
_BARE_HOST = re.compile(
    r" at (?=[A-Za-z0-9-])(?:[A-Za-z0-9-]++(?:\.| dot ))*?[A-Za-z0-9-]++ dot (?:com|org|net|edu|gov|info|io|de|fr|es|eu|uk|test|example|invalid)(?![\w-])", re.I
)
_BARE_LOCAL = re.compile(r"(?:[A-Za-z0-9_%+-]++(?: tod |\.))*+[A-Za-z0-9_%+-]++", re.I)  # of the reversed text
_BARE_DOT = re.compile(" dot ", re.I)

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def detect(text: str) -> list[Span]:
    """Base spans of a text, by start, then by kind as listed."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            segment = text[max(last, text.rfind("@", 0, m.start()) + 1) : m.start()]
            local = len(segment) - len(segment.rstrip(_LOCAL))
            if local:
                out.append(("email", m.start() - local, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Mapped:
    """A normalised text whose positions can be mapped back to the source."""

    def __init__(self, text: str):
        self.text = text
        self._norm, self._src, self._len = [0], [0], [len(text)]  # pieces: start here, start in the source, source length

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply sorted, disjoint replacements (start, end, new) of the current text; offsets compose."""
        if not edits:
            return
        parts, norm, src, length = [], [], [], []
        at = size = 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            k = bisect_right(self._norm, a) - 1
            while a < b:  # the piece's own boundaries stay
                stop = self._norm[k + 1] if k + 1 < len(self._norm) else len(self.text)
                whole = stop - self._norm[k]
                end = min(b, stop)
                if whole == self._len[k]:
                    norm.append(size), src.append(self._src[k] + a - self._norm[k]), length.append(end - a)
                else:
                    norm.append(size), src.append(self._src[k]), length.append(self._len[k])
                parts.append(self.text[a:end])
                size += end - a
                a, k = end, k + 1

        for a, b, new in edits:
            keep(at, a)
            s, _ = self.source(a, b)
            _, e = self.source(a, b)
            if new:
                norm.append(size), src.append(s), length.append(e - s)
                parts.append(new)
                size += len(new)
            at = b
        keep(at, len(self.text))
        self.text, self._norm, self._src, self._len = "".join(parts), norm or [0], src or [0], length or [0]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source range of the characters start..end of the current text."""

        def place(i: int) -> tuple[int, int]:
            k = bisect_right(self._norm, i) - 1
            stop = self._norm[k + 1] if k + 1 < len(self._norm) else len(self.text)
            if stop - self._norm[k] == self._len[k]:
                s = self._src[k] + i - self._norm[k]
                return s, s + 1
            return self._src[k], self._src[k] + self._len[k]

        return place(start)[0], place(end - 1)[1]


def _plain(c: str) -> str | None:
    """ASCII for a character of another script, block or width; None: leave it."""
    if c in _LOOK_ALIKES:
        return _LOOK_ALIKES[c]
    if c in _INVISIBLE:
        return ""
    digit = unicodedata.digit(c, None)
    if digit is not None and ord(c) > 0x2FF:
        return str(digit)
    form = unicodedata.normalize("NFKC", c)
    return form if form != c and form.isascii() and len(form) == 1 else None


def _may_hold_foreign(text: str) -> bool:
    """A quick test that never misses a character of _FOREIGN."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return "\xad" in text or "\xb7" in text or not _LATIN_FORMS.isdisjoint(text)


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        new = []
        for p in _SPELLED_PART.finditer(m.group()):
            new.append("+" if p[1] else _DIGIT_OF[p[2].lower()] if p[2] else p[3] or ".")
        edits.append((m.start(), m.end(), "".join(new)))
    return edits


def _mark_edits(text: str, mark: re.Pattern, sign: str) -> list[tuple[int, int, str]]:
    """Every mark, with the white space around it, becomes the sign."""
    edits, last = [], 0
    for m in mark.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, sign))
        last = b
    return edits


def _bare_edits(text: str) -> list[tuple[int, int, str]]:
    """The words at and dot of each disguised address become signs."""
    edits, last = [], 0
    for m in _BARE_HOST.finditer(text):
        at = m.start()
        name = _BARE_LOCAL.match(text[last:at][::-1])
        last = m.end()
        if name is None:
            continue
        begin = at - name.end()
        edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, begin, at)]
        edits.append((at, at + 4, "@"))
        edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(text, at + 4, m.end())]
    return edits


def normalise(text: str) -> Mapped | None:
    """The text after all transducers, or None if none of them changes it."""
    out = Mapped(text)
    if _may_hold_foreign(text) and _FOREIGN.search(text):
        edits = []
        for m in _FOREIGN.finditer(text):
            new = _plain(m.group())
            if new is not None:
                edits.append((m.start(), m.end(), new))
        out.edit(edits)
    if not _DIGIT_OF.keys().isdisjoint(_SEPARATORS.sub(" ", out.text.lower()).split()):
        edits = _spelled_edits(out.text)
        # each source range becomes one piece a digit run; spans inside it map to the whole run
        out.edit(edits)
    if any(c in out.text for c in "[({<") or "_at_" in out.text:
        out.edit(_mark_edits(out.text, _AT_MARK, "@"))
        out.edit(_mark_edits(out.text, _DOT_MARK, "."))
    if " at " in (low := out.text.lower()) and " dot " in low:
        out.edit(_bare_edits(out.text))
    return out if out.text != text else None


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text in source code points, ends exclusive."""
    base = detect(text or "")
    mapped = normalise(text) if text else None
    if mapped is None:
        return base, base
    # base spans of a kind are sorted and disjoint, and mapping keeps the order, so neighbours tell overlaps
    starts = {k: [s[1] for s in base if s[0] == k] for k in KINDS}
    ends = {k: [s[2] for s in base if s[0] == k] for k in KINDS}
    last = dict.fromkeys(KINDS, 0)
    added = []
    for kind, a, b in detect(mapped.text):
        start, end = mapped.source(a, b)
        k = bisect_left(starts[kind], end) - 1
        if start >= last[kind] and (k < 0 or ends[kind][k] <= start):
            last[kind] = end
            added.append((kind, start, end))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span], mask: str = "<{}>") -> str:
    """The text with each span, overlapping ones taken together, replaced by its first kind's mask."""
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], mask.format(k.upper())]
        at = b
    return "".join(out) + text[at:]


SPAN_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType())]
)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: base counts by kind, digest of the base spans, all spans, how many were added and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = {f.name: [] for f in SPAN_SCHEMA}
            for text in batch.column(1).to_pylist():
                base, spans = find(text)
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                rows["spans"].append(written(spans))
                rows["n_added"].append(len(spans) - len(base))
                rows["n_spans"].append(len(spans))
            rows["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_pydict(rows)

    pair = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return pair.mapInArrow(run, SPAN_SCHEMA)


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents, all columns kept, with every span in the text masked; length_col gets the new length."""
    at = docs.columns.index(text_col)
    n = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t if t is None else redact(t, find(t)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if n is not None:
                columns[n] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
