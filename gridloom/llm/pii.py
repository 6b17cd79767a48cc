"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

A table of detectors is compiled into one projection of built-in functions.
Patterns give leftmost non-overlapping matches of each kind; a validator (part
ranges, Luhn, mod-97, digit counts) drops the failing ones without a retry;
words near a match raise its score: near is at most ``NEAR`` characters to
either side, up to the next match of the pattern.  Spans of the four base kinds
stay whatever their score; those of the added kinds need ``THRESHOLD``, which
social-security numbers and secrets (keys of letters and digits) reach only by
such a word.

Every pattern is possessive or anchored where a run begins (or where the last
match ended), so that long runs are read once.  Offsets are in code points,
the end exclusive.  Rows are judged one by one: no shuffle, no key.

Defined cases: null and empty texts have no spans; ids are not looked at, so
repeated rows and null ids are fine; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.expressions import let, running_before

THRESHOLD = 0.7
#: Characters before and after a match in which context words count.
NEAR = 48


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _card(x: Column) -> Column:
    return let(_digits(x), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))


def _phone(x: Column) -> Column:
    return F.length(_digits(x)).between(8, 15)


_OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _ip(x: Column) -> Column:
    return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


#: The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_length(x: Column) -> Column:
    """Characters of the match that make up the IBAN, solid or in groups of four; null if there is none."""
    due = F.element_at(F.create_map(*(F.lit(v) for pair in IBAN_LENGTHS.items() for v in pair)), F.substring(x, 1, 2))

    def chosen(n: Column) -> Column:
        grouped = n + F.floor((n - 1) / 4).cast("int")
        fits = lambda k: (F.length(F.replace(F.substr(x, F.lit(1), k), F.lit(" "), F.lit(""))) == n) & ~F.substr(x, k + 1, F.lit(1)).rlike("[A-Z0-9]")
        return F.when(fits(n), n).when(fits(grouped), grouped)

    return let(due, chosen)


def _iban(x: Column) -> Column:
    def mod97(compact: Column) -> Column:
        moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))

        def step(s: Column, c: Column) -> Column:
            return F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

        return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1

    return let(_iban_length(x), lambda n: F.when(n.isNull(), F.lit(False)).otherwise(let(F.replace(F.substr(x, F.lit(1), n), F.lit(" "), F.lit("")), mod97)))


def _ssn(x: Column) -> Column:
    return ~x.rlike("^(?:000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Detector:
    kind: str
    pattern: str
    #: A cheap pattern without which no match can be.
    needs: str
    valid: Callable[[Column], Column] | None
    score: float
    context: str
    base: bool
    #: Length of the span within the match, if not the whole.
    length: Callable[[Column], Column] | None = None


def _secret(x: Column) -> Column:
    return F.length(x).between(20, 128) & x.rlike("[0-9]") & x.rlike("[A-Za-z]")


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
DETECTORS = (
    Detector("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", None, 0.9, "mail|contact|write", True),
    Detector("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", _ip, 0.8, "address|host|server|login", True),
    Detector("card", r"[0-9](?:[ -]?[0-9])++", "[0-9][ -]?[0-9]", _card, 0.8, "card|visa|credit|pay", True),
    Detector("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", _phone, 0.7, "phone|tel|call|mobil", True),
    Detector("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+", "[A-Z]{2}[0-9]{2}", _iban, 0.9, "iban|account|bank|konto", False, _iban_length),
    Detector("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-[0-9]{2}-", _ssn, 0.4, "ssn|social|security", False),
    Detector("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", "[A-Za-z0-9_-]{20}", _secret, 0.4, "token|secret|key|passw", False),
)
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"


def spans(text: Column, d: Detector) -> Column:
    """The spans of one kind in a text, in order."""

    def built(m: Column, gaps: Column) -> Column:
        steps = F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(gaps, i))).cast("long"))

        def of(before: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(gaps, i))
                around = F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR)))
                score = F.lit(d.score) + F.when(F.lower(around).rlike(d.context), 0.1 if d.base else 0.4).otherwise(0.0)
                size = d.length(x) if d.length else F.length(x)
                return F.struct(
                    F.lit(d.kind).alias("kind"), start.cast("long").alias("start"), (start + size).cast("long").alias("end"),
                    (F.substr(x, F.lit(1), size) if d.length else x).alias("value"), F.least(score, F.lit(1.0)).alias("score"),
                    (d.valid(x) if d.valid else F.lit(True)).alias("ok"),
                )

            good = F.filter(F.transform(m, one), lambda s: s["ok"] if d.base else s["ok"] & (s["score"] >= THRESHOLD))
            return F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")))

        return let(running_before(steps), of)

    matched = let(
        F.struct(F.regexp_extract_all(text, F.lit(d.pattern), F.lit(0)).alias("m"), F.split(text, d.pattern, -1).alias("g")),
        lambda p: F.when(F.size(p["m"]) == 0, F.array().cast(SPAN)).otherwise(built(p["m"], p["g"])),
    )
    return F.when(text.rlike(d.needs), matched).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """One row a document: id and, for each kind, the array of its spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), *(spans(text, d).alias(d.kind) for d in detectors))


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans of these kinds, joined by commas."""
    each = [F.transform(k, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def scored(*kinds: str) -> Column:
    """The scores of these kinds' spans in hundredths, in the order of ``listed``, joined by commas."""
    each = [F.transform(k, lambda s: F.round(100 * s["score"]).cast("int").cast("string")) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def redact(docs: DataFrame, *, text_col: str = "text", detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """The documents with each span of ``text_col`` replaced by its kind in brackets; of overlapping spans the first stands."""
    text = F.col(f"`{text_col}`")
    every = F.array_sort(F.transform(F.flatten(F.array(*(spans(text, d) for d in detectors))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        parts = F.concat(acc["parts"], F.array(F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), parts.alias("parts")))

    zero = F.expr("struct(0L as at, cast(array() as array<string>) as parts)")
    done = F.aggregate(every, zero, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, (a["at"] + 1).cast("int"))))
    cleaned = F.when(text.isNotNull(), done)
    return docs.select(*(cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
