"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, URL schemes, plus signs, digits and identifier
cues; a deterministic local parser at each anchor expands to the left and right and validates.

Kinds, in order: email, ip, card, phone (the base kinds, leftmost and non-overlapping within a kind,
failing matches dropped without a retry), then what the method adds: address (a URL that carries a
user name, or a mailto: or tel: target) and account (a value after an identifier cue such as
``iban``, ``account number``, ``ssn``, ``api_key`` or ``token``). Offsets are code points, end exclusive.

Defined cases: a null text is an empty one and has no spans; repeated and null doc_ids are rows like
any others; extra columns are not read by ``find_pii`` and are kept by ``redact_pii``.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.tokens import slices
from loomtrace.runtime import ship_package

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "sftp://", "mailto:", "tel:")
CUES = ("iban", "account", "acct", "ssn", "passport", "token", "api_key", "apikey", "api-key", "secret", "password", "passwd")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#<>\"']+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s<>\"']*")
_TARGET = re.compile(r"[A-Za-z0-9._%+@-]*[A-Za-z0-9]")
_CUE_GAP = re.compile(r"(?:[ _-]?(?:number|num|no|id|key)\b)?\.?\s{0,3}(?:[:=#]|is\b)\s{0,3}[\"']?", re.I)
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9/+_-]*(?:[ ][A-Z0-9]{4}(?![A-Za-z0-9]))*(?:[ ][A-Z0-9]{1,3}(?![A-Za-z0-9]))?")

_automaton = None


def _anchors():
    """The automaton, built once in each worker process. Its values are (kind, length)."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        _automaton.add_word("@", ("at", 1))
        _automaton.add_word("+", ("plus", 1))
        for digit in "0123456789":
            _automaton.add_word(digit, ("digit", 1))
        for word in (*SCHEMES, *CUES):
            kind = "scheme" if word in SCHEMES else "cue"
            for form in {word, word.capitalize(), word.upper()}:
                _automaton.add_word(form, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d)
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def iban(value: str) -> bool:
    value = value.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(cue: str, value: str) -> bool:
    """Whether a value after a cue looks like an identifier and not a word."""
    n = len(_digits(value))
    if cue == "iban":
        return iban(value)
    if cue in ("account", "acct", "ssn", "passport"):
        return n >= 6
    return len(value) >= 8 and n >= 2


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end) of every span, sorted."""
    spans: list[tuple[int, int, int]] = []
    done = {"at": 0, "ip": 0, "card": 0, "plus": 0, "scheme": 0, "cue": 0}
    run_end = 0
    for last, (kind, size) in _anchors().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at < run_end:
                continue
            # The first digit of a run; runs joined by single dots, spaces or hyphens are parsed from their head.
            if at >= done["ip"] and (m := _DOTTED.match(text, at)):
                done["ip"] = m.end()
                if all(map(_byte, m[0].split("."))):
                    spans.append((at, 1, m.end()))
            if at >= done["card"] and (m := _CHAIN.match(text, at)):
                done["card"] = m.end()
                digits = _digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, 2, m.end()))
            run_end = at + 1
            while run_end < len(text) and "0" <= text[run_end] <= "9":
                run_end += 1
        elif kind == "at":
            start = at
            while start > done["at"] and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                spans.append((start, 0, m.end()))
                done["at"] = m.end()
            else:
                done["at"] = max(done["at"], at + 1)
        elif kind == "plus":
            if m := _PHONE.match(text, at):
                if 9 <= len(_digits(m[0])) <= 15:
                    spans.append((at, 3, m.end()))
        elif kind == "scheme":
            if at >= done["scheme"] and not (at and text[at - 1].isalnum()):
                tail = _TARGET if text[last] == ":" else _AUTHORITY
                if (m := tail.match(text, last + 1)) and (tail is _AUTHORITY or "@" in m[0] or len(_digits(m[0])) >= 7):
                    spans.append((at, 4, m.end()))
                    done["scheme"] = m.end()
        elif at >= done["cue"] and not (at and text[at - 1].isalnum()):
            if (gap := _CUE_GAP.match(text, last + 1)) and (m := _VALUE.match(text, gap.end())):
                if _account(text[at : last + 1].lower(), m[0]):
                    spans.append((m.start(), 5, m.end()))
                    done["cue"] = m.end()
    return sorted(set(spans))


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find_partitions(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole, "text"):
            out = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                spans = find_spans(text or "")
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                for k in range(4):
                    out[k].append(sum(1 for s in base if s[1] == k))
                out[4].append(hashlib.sha256(_join(base).encode()).hexdigest())
                out[5].append(_join(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans per document; one pass over the texts, no shuffle."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find_partitions, FOUND_SCHEMA)


def redact_text(text: str) -> str:
    """Each maximal union of overlapping spans becomes the placeholder of its first kind."""
    out, at = [], 0
    spans = find_spans(text)
    k = 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"<{KINDS[kind]}>"]
        at = end
    return "".join(out) + text[at:] if out else text


def _redact_partitions(name: str, count: str | None):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, name):
                new = [None if t is None else redact_text(t) for t in batch.column(name).to_pylist()]
                k = batch.schema.get_field_index(name)
                batch = batch.set_column(k, batch.schema.field(k).with_type(pa.string()), pa.array(new, pa.string()))
                if count and (at := batch.schema.get_field_index(count)) >= 0:
                    sizes = pa.array([None if t is None else len(t) for t in new], pa.int64())
                    batch = batch.set_column(at, count, sizes.cast(batch.schema.field(at).type))
                yield batch

    return run


def redact_pii(docs: DataFrame, text: str = "text", count: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced by typed placeholders.

    ``count`` names a column that holds the text's length and is kept right, where there is one."""
    ship_package(docs.sparkSession)
    return docs.mapInArrow(_redact_partitions(text, count if count in docs.columns else None), docs.schema)
