"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a built-in SQL function. ``split`` gives the text between matches and
``regexp_extract_all`` the matches, so running lengths give each match's place in code points.

Defined cases: a null text is empty and has no span; rows are independent, so ties, repeated rows and
other columns don't matter (the column that :func:`find_pii` adds replaces one of the same name; :func:`redact` adds none);
an empty table gives an empty table. The expressions never backtrack over more than one run, so very long texts
take time in proportion to their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. Possessive forms match what the greedy ones would, without their stack and backtracking."""

    name: str
    pattern: str
    valid: str
    score: float
    context: str
    base: bool = True
    needs: str | None = None


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str, least: int, most: int) -> str:
    d = f"reverse({_digits(m)})"
    digit = f"cast(substring({d}, k, 1) as int)"
    total = f"aggregate(sequence(1, length({d})), 0, (t, k) -> t + if(k % 2 = 1, {digit}, {digit} * 2 - if({digit} > 4, 9, 0)))"
    return f"case when length({d}) between {least} and {most} then {total} % 10 = 0 else false end"


def _mod97(m: str) -> str:
    s = f"replace({m}, ' ', '')"
    turned = f"concat(substring({s}, 5), substring({s}, 1, 4))"
    c = f"ascii(substring({turned}, k, 1))"
    rest = f"aggregate(sequence(1, length({s})), 0, (r, k) -> if({c} < 58, (r * 10 + {c} - 48) % 97, (r * 100 + {c} - 55) % 97))"
    return f"case when length({s}) between 15 and 34 then {rest} = 1 else false end"


#: The lengths of IBANs by country.
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21"
    " HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24"
    " RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def _iban() -> str:
    """A country's letters, two check digits, and just as many letters and digits as that country's numbers have, so that what follows isn't read along."""
    by: dict[int, list[str]] = {}
    for entry in _IBAN_LENGTHS.split():
        by.setdefault(int(entry[2:]), []).append(entry[:2])
    kinds = "|".join(f"(?:{'|'.join(names)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in sorted(by.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{kinds})(?![A-Za-z0-9])"


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"
_CARD = "(?<![0-9])[0-9](?:[ -]?[0-9])++"
_CARD_WORDS = "card|visa|master|amex|credit|debit|pan|karte|carte|tarjeta"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, "mail|contact|write|kontakt", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"m rlike '^{_PART}([.]{_PART}){{3}}$'", 0.6, "ip|host|server|address|login"),
    Kind("card", _CARD, _luhn("m", 16, 19), 0.8, _CARD_WORDS),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_digits('m')}) between 8 and 15", 0.6, "phone|tel|call|mobile|fax|cell", needs="+"),
    Kind("iban", _iban(), _mod97("m"), 0.7, "iban|bank|account|konto|compte|cuenta", base=False),
    Kind("shortcard", _CARD, _luhn("m", 13, 15), 0.35, _CARD_WORDS, base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "m rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'", 0.35, "ssn|social|security|insured", base=False),
)
#: Further spans need this score; the spans of the base kinds always stay.
THRESHOLD = 0.5
CONTEXT_CHARS, CONTEXT_BONUS = 40, 0.3


def _spans(kind: Kind, text: str) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed matches of one kind in column ``text``."""
    pattern = kind.pattern.replace("\\", "\\\\").replace("'", "\\'")
    valid = kind.valid.replace("\\", "\\\\")
    none = "cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)"
    start = "s.at + length(get(x.p, s.i))"
    near = f"lower(substring({text}, greatest({start} - {CONTEXT_CHARS} + 1, 1), least({start}, {CONTEXT_CHARS}))) rlike '({kind.context})'"
    span = f"named_struct('kind', '{kind.name}', 'start', {start}, 'end', {start} + length(m), 'score', least(1.0D, {kind.score}D + if({near}, {CONTEXT_BONUS}D, 0.0D)))"
    kept = f"case when {valid} then array({span}) else {none} end"
    kept = kept if kind.base else f"filter({kept}, z -> z.score >= {THRESHOLD}D)"
    fold = (
        f"aggregate(x.m, named_struct('i', 0, 'at', 0, 'out', {none}), (s, m) -> named_struct("
        f"'i', s.i + 1, 'at', {start} + length(m), 'out', concat(s.out, {kept})), s -> s.out)"
    )
    # a one-element transform names the matches and pieces once
    found = f"named_struct('m', regexp_extract_all({text}, '{pattern}', 0), 'p', split({text}, '{pattern}', -1))"
    whole = f"get(transform(array({found}), x -> {fold}), 0)"
    some = f"contains({text}, '{kind.needs}')" if kind.needs else "true"
    return F.expr(f"case when {some} and {text} rlike '{pattern}' then {whole} else {none} end")


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array<struct<kind, start, end, score>> in the order of KINDS, then start."""
    held = docs.withColumn("__text", common.text_of(text))
    return held.withColumn(out, F.concat(*(_spans(k, "__text") for k in KINDS))).drop("__text")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, n_spans, top_score."""
    base = [k.name for k in KINDS if k.base]
    found = find_pii(docs.select("doc_id", "text"))
    counts = [F.expr(f"size(filter(pii, s -> s.kind = '{n}'))").cast("long").alias(f"n_{n}") for n in base]
    only = F.filter("pii", lambda s: s.kind.isin(base))
    return found.select(
        "doc_id", *counts, F.sha2(joined(only), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"), F.array_max(F.transform("pii", lambda s: s.score)).alias("top_score"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``[KIND]``; overlapping spans become one, named after the first.

    A null text stays null. ``n_chars``, where there is one, is brought up to date.
    """
    at = "array_sort(__pii, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 when a.end > b.end then -1 when a.end < b.end then 1 else 0 end)"
    cut = (
        f"aggregate({at}, named_struct('at', 0, 'out', cast(array() as array<string>)), (s, z) -> case when z.start >= s.at"
        " then named_struct('at', z.end, 'out', concat(s.out, array(substring(`TEXT`, s.at + 1, z.start - s.at), concat('[', upper(z.kind), ']'))))"
        " else named_struct('at', greatest(s.at, z.end), 'out', s.out) end,"
        " s -> concat(array_join(s.out, ''), substring(`TEXT`, s.at + 1)))"
    ).replace("TEXT", text)
    found = find_pii(docs, text, "__pii")
    done = found.withColumn(text, F.when(F.size("__pii") > 0, F.expr(cut)).otherwise(F.col(text))).drop("__pii")
    return done.withColumn("n_chars", F.char_length(text).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done
