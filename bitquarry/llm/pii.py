"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Only DataFrame and SQL functions.  Offsets count code points, the end is
exclusive.  A kind's spans are the leftmost non-overlapping matches of its
pattern that pass its validator; failing matches are dropped, not retried.
Kinds are searched independently, so spans of different kinds may overlap.

The patterns are written with possessive quantifiers and look-behind where a
plain pattern would try every start within a long run; they match what the
plain ones match.  Start offsets come from the gaps between matches: a
prefix sum by doubling steps, so documents with many matches stay cheap.

Context words are searched within ``CONTEXT_CHARS`` of the text on both sides
(``redact``, and ``detect`` with ``whole_context``); without it ``detect`` ends
the window at the neighbouring matches of the kind.

Results for odd input: a null or empty text has no spans; repeated rows each
get their row; an empty table gives an empty result.  Columns that are added
replace equally named ones of the input (case-insensitively); the rest of the
input is kept by ``detect`` and ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters before and after a match that are searched for context words.
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3


@dataclass(frozen=True)
class Kind:
    """``valid`` is a SQL predicate of the matched string ``{x}``; ``gate`` a cheap SQL test of the text ``{t}``."""

    name: str
    pattern: str
    valid: str
    gate: str
    score: float
    context: str
    #: The score from which a span is reported; base kinds always are.
    least: float = 0.0


_DIGITS = "regexp_replace({x}, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (acc, j) -> acc + case when j % 2 = 1 "
    "then int(substr({d}, -j, 1)) else int(substr('0246813579', int(substr({d}, -j, 1)) + 1, 1)) end) % 10 = 0"
).replace("{d}", _DIGITS)
_PLAIN = "replace({x}, ' ', '')"
_MOD97 = (
    "aggregate(split(concat(substr({c}, 5), substr({c}, 1, 4)), ''), 0, (acc, c) -> "
    "case when c = '' then acc when c between '0' and '9' then (acc * 10 + int(c)) % 97 "
    "else (acc * 100 + ascii(c) - 55) % 97 end) = 1"
).replace("{c}", _PLAIN)
_OCTET = "regexp_replace(p, '^0+', '')"

#: The base kinds' patterns and limits, the validators and the context words.
KINDS: tuple[Kind, ...] = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        "contains({t}, '@')",
        0.6,
        r"(?i)e-?mail|contact|write|reach",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        f"forall(split({{x}}, '[.]'), p -> if(length({_OCTET}) <= 3, int(concat('0', {_OCTET})) <= 255, false))",
        "{t} rlike '[0-9][.][0-9]'",
        0.5,
        r"(?i)address|host|server|login",
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?[0-9])++",
        f"if(length({_DIGITS}) between 16 and 19, {_LUHN}, false)",
        "{t} rlike '[0-9][ -]?[0-9]'",
        0.7,
        r"(?i)card|visa|credit|debit|payment|cvv",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        f"length({_DIGITS}) between 8 and 15",
        "contains({t}, '+')",
        0.5,
        r"(?i)phone|tel|call|mobile|fax",
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
        f"if(length({_PLAIN}) between 15 and 34, {_MOD97}, false)",
        "{t} rlike '[A-Z]{{2}}[0-9]{{2}}[ A-Z0-9]'",
        0.8,
        r"(?i)iban|account|bank|transfer",
        0.5,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "not ({x} rlike '^(000|666|9)' or {x} like '___-00-____' or {x} like '%-0000')",
        "{t} rlike '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'",
        0.3,
        r"(?i)ssn|social|security|taxpayer",
        0.5,
    ),
)
BASE = ("email", "ip", "card", "phone")


def _quoted(value: str) -> str:
    return "r'" + value + "'"


def _spans(kind: Kind, whole_context: bool) -> tuple[str, str]:
    """SQL for the ends and the spans of the kind's matches ``_m_<kind>``, between gaps ``_g_<kind>``."""
    m, g = f"`__bq_m_{kind.name}`", f"`__bq_g_{kind.name}`"
    steps = f"transform(sequence(0, int(floor(log2(size({m}))))), k -> shiftleft(1, k))"
    lengths = f"transform({m}, (x, i) -> length(x) + length({g}[i]))"
    ends = f"aggregate({steps}, {lengths}, (acc, d) -> transform(acc, (x, i) -> x + if(i >= d, acc[i - d], 0)))"
    n = CONTEXT_CHARS
    words = _quoted(kind.context)
    close = f"right({g}[i], {n}) rlike {words} or left({g}[i + 1], {n}) rlike {words}"
    if whole_context:
        # No match is shorter than two characters, so n / 2 neighbours fill the window.
        back = f"greatest(i - {n // 2}, 0)"
        before = f"transform(slice({m}, {back} + 1, i - {back}), (y, k) -> concat(right({g}[{back} + k], {n}), right(y, {n})))"
        after = f"transform(slice({m}, i + 2, {n // 2}), (y, k) -> concat(left(y, {n}), left({g}[i + 2 + k], {n})))"
        before = f"right(concat(array_join({before}, ''), right({g}[i], {n})), {n}) rlike {words}"
        after = f"left(concat(left({g}[i + 1], {n}), array_join({after}, '')), {n}) rlike {words}"
        close = f"{kind.valid.format(x='x')} and ({close} or length({g}[i]) < {n} and {before} or length({g}[i + 1]) < {n} and {after})"
    near = f"case when {close} then {CONTEXT_BONUS}D else 0D end"
    found = (
        f"filter(transform({m}, (x, i) -> named_struct('kind', '{kind.name}', 'start', `__bq_e_{kind.name}`[i] - length(x), 'end', `__bq_e_{kind.name}`[i], "
        f"'text', x, 'score', least(1D, {kind.score}D + {near}))), s -> {kind.valid.format(x='s.text')} and s.score >= {kind.least}D)"
    )
    return ends, found


def _where_empty(name: str, sql: str, kind: str) -> str:
    return f"if(size(`__bq_m_{name}`) > 0, {sql}, cast(array() as {kind}))"


SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def detect(docs: DataFrame, text: str = "text", out: str = "pii", whole_context: bool = False) -> DataFrame:
    """Add ``out``: an array of (kind, start, end, text, score), by kind as in ``KINDS``, then start."""
    df = docs.withColumn("__bq_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns(
        {
            f"__bq_m_{k.name}": F.expr(f"if({k.gate.format(t='__bq_t')}, regexp_extract_all(__bq_t, {_quoted(k.pattern)}, 0), cast(array() as array<string>))")
            for k in KINDS
        }
    )
    df = df.withColumns({f"__bq_g_{k.name}": F.expr(_where_empty(k.name, f"split(__bq_t, {_quoted(k.pattern)}, -1)", "array<string>")) for k in KINDS})
    df = df.withColumns({f"__bq_e_{k.name}": F.expr(_where_empty(k.name, _spans(k, whole_context)[0], "array<int>")) for k in KINDS})
    df = df.withColumns({f"__bq_s_{k.name}": F.expr(_where_empty(k.name, _spans(k, whole_context)[1], SPAN)) for k in KINDS})
    df = df.withColumn(out, F.concat(*[F.col(f"__bq_s_{k.name}") for k in KINDS]))
    return df.drop("__bq_t", *[f"__bq_{p}_{k.name}" for k in KINDS for p in "mges"])


def digest(found: DataFrame, pii: str = "pii") -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as one string."""
    rows = found.select("doc_id", *[F.expr(f"filter({pii}, s -> s.kind = '{k}')").alias(f"_{k}") for k in BASE], F.col(pii).alias("_all"))
    joined = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.concat(*[F.col(f"_{k}") for k in BASE]))
    return rows.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), joined(F.col("_all")).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", tag: str = "[PII]") -> DataFrame:
    """The documents with every found span replaced by ``tag``; overlapping spans become one.

    The running maximum of the spans' ends, again by doubling steps, tells
    where one run of overlapping spans stops and the next one starts.
    """
    text = next((c for c in docs.columns if c.lower() == text.lower()), text)  # keeps the column's own spelling
    docs = docs.withColumn("__bq_tag", F.lit(tag))
    steps = "transform(sequence(0, int(floor(log2(size(__bq_p))))), k -> shiftleft(1, k))"
    reach = f"aggregate({steps}, transform(__bq_p, s -> s.end), (acc, d) -> transform(acc, (x, i) -> if(i >= d, greatest(x, acc[i - d]), x)))"
    df = detect(docs, text, "__bq_pii", whole_context=True)
    df = df.withColumn("__bq_p", F.expr("array_sort(transform(__bq_pii, s -> named_struct('start', s.start, 'end', s.end)))"))
    df = df.withColumn("__bq_r", F.expr(f"if(size(__bq_p) > 0, {reach}, cast(array() as array<int>))"))
    df = df.withColumn("__bq_f", F.expr("filter(transform(__bq_p, (s, i) -> if(i = 0 or s.start >= __bq_r[i - 1], i, -1)), i -> i >= 0)"))
    kept = (
        f"transform(__bq_f, (i, n) -> substr(`{text}`, if(n = 0, 0, __bq_r[i - 1]) + 1, __bq_p[i].start - if(n = 0, 0, __bq_r[i - 1])))"
    )
    tail = f"substr(`{text}`, element_at(__bq_r, -1) + 1)"
    df = df.withColumn(text, F.expr(f"if(size(__bq_p) = 0, `{text}`, array_join(array_append({kept}, {tail}), __bq_tag))"))
    return df.drop("__bq_pii", "__bq_p", "__bq_r", "__bq_f", "__bq_tag")
