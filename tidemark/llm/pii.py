"""Personal data by regular expressions, checksums and context, in SQL functions only.

Expressions propose spans; checksums (Luhn for cards, ISO 7064 mod 97-10 for account numbers) and
value ranges confirm them; words near a span adjust its score. The base kinds always stay once they
are confirmed; the added kinds stay if their score reaches ``KEEP``.

Positions come from splitting a text at its matches: the pieces between matches and the matches
themselves alternate, so a match starts where the lengths before it add up to. Repetitions in the
expressions are possessive, which changes no match here and keeps the regex engine from recursing
on long runs.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order, then the added ones.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
# Characters of an account number by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    return "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))


_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    # a match starts where a run of local characters starts or where the last match ended
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_iban()})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # a long run of the characters of keys and tokens (the whole run, as shorter ones match nowhere), or a private key in its envelope
    "secret": r"[A-Za-z0-9_+/=.-]{16,}+|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
}
#: What a key of a known issuer or a private key starts with; such a span needs no words near it.
ISSUED = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_|glpat-|sk-[A-Za-z0-9]|sk_live_|rk_live_|xox[abprs]-|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]+\.|npm_[A-Za-z0-9]{30,}|-----BEGIN )"
#: A cheap test that a text may have the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]", "secret": r"[A-Za-z][_+/=.-]*+[0-9]|[0-9][_+/=.-]*+[A-Za-z]|PRIVATE KEY"}
#: Score of a confirmed span, what a context word adds, and the words.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": "mail|e-mail|contact|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|karte|carte|tarjeta|credit",
    "phone": "phone|tel|call|mobile|fax|telefon|movil",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
    "secret": "token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|authorization|bearer|credential|credentials|key",
}
BOOST, KEEP, NEAR = 0.2, 0.5, 40
#: Different characters, a digit and a letter among them, that a secret has.
VARIETY = 8
#: The characters that count; asking for each of them needs no split of a long run.
KEY_CHARACTERS = string.ascii_letters + string.digits + "_+/=.-"
#: Values that are folded one by one; longer lists fold blocks, and blocks of blocks, first.
RUN = 128
#: Characters of a chunk of a text from which parts are taken.
CHUNK = 4096

_SPAN = "array<struct<start:int,end:int,kind:string,rank:int,score:double>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), then)[0]


def _sum(of: Column) -> Column:
    return F.aggregate(of, F.lit(0), lambda a, x: a + x)


def _most(of: Column) -> Column:
    return F.coalesce(F.array_max(of), F.lit(0))


def _running(values: Column, fold: Callable[[Column], Column], then: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``then(upto)`` where ``upto(i)`` folds the first i values; each of them looks at few values, blocks and blocks of blocks."""

    def blocks_of(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest((F.size(x) - 1) / RUN, F.lit(0)).cast("int")), lambda b: fold(F.slice(x, b * RUN + 1, F.lit(RUN))))

    def use(x: Column) -> Column:
        def upto(i: Column) -> Column:
            block, large = (i / RUN).cast("int"), (i / (RUN * RUN)).cast("int")
            return fold(F.concat(F.slice(x["large"], F.lit(1), large), F.slice(x["blocks"], large * RUN + 1, block - large * RUN), F.slice(x["values"], block * RUN + 1, i - block * RUN)))

        return then(upto)

    with_large = lambda x: _let(F.struct(x["values"].alias("values"), x["blocks"].alias("blocks"), blocks_of(x["blocks"]).alias("large")), use)
    return _let(values, lambda x: _let(F.struct(x.alias("values"), blocks_of(x).alias("blocks")), with_large))


def located(text: Column, pattern: str) -> Column:
    """Matches as array of ``struct(start, end, hit, near)``.

    start and end count code points, end is exclusive; near is the match with up to NEAR characters on
    either side, no further than the next match.
    """

    def place(found: Column) -> Column:
        gaps = found["gaps"]

        def step(hit: Column, i: Column) -> Column:
            before, after = F.get(gaps, i), F.get(gaps, i + 1)
            near = F.lower(F.concat(F.substring(before, -NEAR, NEAR), hit, F.substring(after, 1, NEAR)))
            return F.struct((F.length(before) + F.length(hit)).alias("step"), F.length(hit).alias("len"), hit.alias("hit"), near.alias("near"))

        return _let(F.transform(found["hits"], step), add_up)

    def add_up(steps: Column) -> Column:
        def spans(upto: Callable[[Column], Column]) -> Column:
            def one(step: Column, i: Column) -> Column:
                return _let(upto(i + 1), lambda end: F.struct((end - step["len"]).alias("start"), end.alias("end"), step["hit"].alias("hit"), step["near"].alias("near")))

            return F.transform(steps, one)

        return _running(F.transform(steps, lambda s: s["step"]), _sum, spans)

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return _let(found, place)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    """Remainder of an account number: its first four characters go last, letters count from 10."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    codes = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda r, c: F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97))


def _byte_parts(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


CONFIRM: dict[str, Callable[[Column], Column]] = {
    "email": lambda h: F.lit(True),
    "ip": _byte_parts,
    "card": lambda h: _let(_digits(h), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d)),
    "phone": lambda h: F.length(_digits(h)).between(9, 15),
    "iban": lambda h: _mod97(h) == 1,
    "ssn": lambda h: ~h.rlike("^(?:000|666|9)") & ~h.rlike("-00-|-0000$"),
    "secret": lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]") & (F.size(F.filter(F.array(*map(F.lit, KEY_CHARACTERS)), lambda c: F.contains(h, c))) >= VARIETY),
}


def _of_kind(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind with their scores."""

    def span(s: Column) -> Column:
        boost = F.when(s["near"].rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"), BOOST).otherwise(0.0)
        prior = F.when(s["hit"].rlike(ISSUED), 0.8).otherwise(PRIOR[kind]) if kind == "secret" else F.lit(PRIOR[kind])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), F.least(F.lit(1.0), prior + boost).alias("score"))

    spans = F.transform(F.filter(located(text, PATTERNS[kind]), lambda s: CONFIRM[kind](s["hit"])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= KEEP)
    hint = F.contains(text, F.lit(HINTS[kind])) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
    return F.when(hint, spans).otherwise(F.array()).cast(_SPAN)


def pii_spans(text: Column) -> Column:
    """All spans by start, then kind in the order of ``KINDS``; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    spans = F.concat(*[_of_kind(text, kind) for kind in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"))))
    return ordered


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans (all of them).

    Spans of different kinds may overlap; all are reported. Rows do not move. An empty table stays
    empty; columns with the new names are replaced.
    """
    out = df.withColumn("spans", pii_spans(F.col(text_col)))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{k}": number(k) for k in BASE}
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    out = out.withColumns(counts | {"base_sha256": F.sha2(_joined(base).cast("binary"), 256), "n_added": (F.size("spans") - F.size(base)).cast("long"), "n_spans": F.size("spans").cast("long")})
    return out.withColumn("spans", _joined(F.col("spans")))


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span in the text column replaced by its kind in brackets, such as ``[EMAIL]``.

    Overlapping spans become one, named by the first. A text without spans stays as it is, a null
    text null and an empty one empty. Rows don't move: repeated rows stay repeated, an empty table
    stays empty, and other columns, whatever their names, are kept.
    """

    def merged(spans: Column) -> Column:
        """Spans that do not overlap: a new one starts where all spans before have ended."""

        def cut(upto: Callable[[Column], Column]) -> Column:
            fresh = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("nth"), s["kind"].alias("kind"), upto(i).alias("before"))), lambda s: s["start"] >= s["before"])
            last = upto(F.size(spans))
            end = lambda all_, i: F.coalesce(F.get(all_, i + 1)["before"], last)
            return _let(fresh, lambda f: F.transform(f, lambda s, i: F.struct(s["start"].alias("start"), end(f, i).alias("end"), s["kind"].alias("kind"))))

        return _running(F.transform(spans, lambda s: s["end"]), _most, cut)

    def rebuild(chunks: Column, spans: Column, n: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = (a / CHUNK).cast("int")
            some = F.array_join(F.slice(chunks, first + 1, (b / CHUNK).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(some, a - first * CHUNK + 1, b - a)).otherwise("")

        def piece(s: Column, i: Column) -> Column:
            start = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
            return F.concat(between(start, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        return F.concat(F.array_join(F.transform(spans, piece), ""), between(F.element_at(spans, -1)["end"], n))

    text = F.col(f"`{text_col}`")
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = lambda spans: _let(F.struct(merged(spans).alias("m"), chunks.alias("c")), lambda x: rebuild(x["c"], x["m"], F.length(text)))
    return df.withColumn(text_col, _let(pii_spans(text), lambda spans: F.when(F.size(spans) > 0, whole(spans)).otherwise(text)))
