"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Built from SQL functions only.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, its score before context, and the context words that raise it."""

    name: str
    pattern: str
    score: float
    context: str


#: The first four are the base kinds, in their order.  Possessive quantifiers and the look-behinds only
#: spare the engine retries that cannot match; they keep each kind's leftmost matches.
EMAIL_CHARS = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{EMAIL_CHARS})){EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", 0.7, "card|visa|credit|debit|payment|master"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|cell"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.7, "iban|bank|account|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security|tax"),
    Kind("secret", r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])", 0.3, "token|secret|api|key|passwor|passwd|auth|bearer|credential"),
)
BASE = 4
#: Characters of a secret, at most.
MOST_SECRET = 256
#: Lengths are summed by blocks of so many, and these by as many again.
BLOCK_BITS = 5
BLOCK = 1 << BLOCK_BITS
#: Characters looked at before and after a span; what a context word adds; the score an added span needs.
BEFORE, AFTER, BONUS, LEAST = 48, 24, 0.25, 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, is 1 modulo 97."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 1 << 20), F.substring(bare, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c >= "A", acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + c.cast("int")) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & F.when(F.length(digits) <= 19, luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "secret":
        # letters and digits mixed throughout, as keys are: words, paths and numbers aren't
        digits = F.length(_digits(value))
        return (F.length(value) <= MOST_SECRET) & (digits * 16 >= F.length(value)) & (digits < F.length(value)) & ~value.rlike("[A-Za-z]{20}|/.*/.*/")
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string,score:double>>"


def _sums(a: Column) -> Column:
    """The sum of each BLOCK values, in order."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(a) - 1, BLOCK_BITS)), lambda j: F.aggregate(F.slice(a, j * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda x, y: x + y))


def _before(a: Column, above: Column | None = None) -> Column:
    """The sum of the values before each one; ``above`` has that of the first of each BLOCK values."""

    def at(_: Column, i: Column) -> Column:
        if above is None:
            return F.aggregate(F.slice(a, F.lit(1), i), F.lit(0), lambda x, y: x + y)
        k = i.bitwiseAND(F.lit(BLOCK - 1))
        return F.get(above, F.shiftright(i, BLOCK_BITS)) + F.aggregate(F.slice(a, i - k + 1, k), F.lit(0), lambda x, y: x + y)

    # named twice, so that it stays a column of its own; named once, it would be worked out for each value
    return F.transform(a, at) if above is None else F.when(F.size(above) > 0, F.transform(a, at))


def _lengths(rank: int) -> Column:
    """How far each match's end lies from the end before."""
    return F.transform(F.col(f"_m{rank}"), lambda m, i: F.length(F.get(F.col(f"_p{rank}"), i)) + F.length(m))


def _found(rank: int, kind: Kind) -> Column:
    """Valid spans of a kind from its matches, the pieces between them and their starts."""
    pieces, matches = F.col(f"_p{rank}"), F.col(f"_m{rank}")

    def span(value: Column, i: Column) -> Column:
        start = F.get(F.col(f"_s{rank}"), i) + F.length(F.get(pieces, i))
        near = F.lower(F.concat(F.right(F.get(pieces, i), F.lit(BEFORE)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(AFTER))))
        score = F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.context})"), BONUS).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.when(F.size(f"_s{rank}") > 0, F.transform(matches, span))
    return F.filter(spans, lambda s: _valid(kind.name, s["value"]) & ((F.lit(rank) < BASE) | (s["score"] >= LEAST)))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of (start, rank, kind, end, value, score) by start, then kind.

    Base spans (email, ip, card, phone) stay whatever their score; iban, ssn
    and secret (keys and tokens) are added where their check passes and the
    score, raised by context words up to BEFORE characters before or AFTER
    after, reaches LEAST: context decides for ssn and secret.  A
    null or empty text has no spans.  Rows stay as they come, repeated ones
    too; an empty table gives none.  Only doc_id and text are read.
    """
    text = F.col("_text")
    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    # each step is a projection of its own, so that a pattern runs once over a text
    out = out.select("*", *(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias(f"_m{r}") for r, k in enumerate(KINDS)))
    some = [F.size(f"_m{r}") > 0 for r in range(len(KINDS))]
    out = out.select("*", *(F.when(some[r], F.split(text, k.pattern, -1)).alias(f"_p{r}") for r, k in enumerate(KINDS)))
    # running sums of lengths by blocks of blocks, as a fold would copy what it has so far for each match
    steps = (("_a", _lengths), ("_b", lambda r: _sums(F.col(f"_a{r}"))), ("_c", lambda r: _sums(F.col(f"_b{r}"))), ("_d", lambda r: _before(F.col(f"_c{r}"))))
    steps += (("_e", lambda r: _before(F.col(f"_b{r}"), F.col(f"_d{r}"))), ("_s", lambda r: _before(F.col(f"_a{r}"), F.col(f"_e{r}"))))
    for name, step in steps:
        out = out.select("*", *(F.when(some[r], step(r)).alias(f"{name}{r}") for r in range(len(KINDS))))
    found = [F.when(some[r], _found(r, k)).otherwise(F.array().cast(SPAN)).cast(SPAN) for r, k in enumerate(KINDS)]
    return out.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def contract(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_pii``'s rows: base_sha256 is of base spans, scores lie beside spans, each kind has its count."""

    def of(rank: int) -> Column:  # a lambda with a default would be taken for one with an index
        return F.filter("spans", lambda s: s["rank"] == rank)

    base = F.filter("spans", lambda s: s["rank"] < BASE)
    counts = [F.size(of(r)).cast("long").alias(f"n_{KINDS[r].name}") for r in range(BASE)]
    added = [F.size(of(r)).cast("long").alias(f"n_{KINDS[r].name}") for r in range(BASE, len(KINDS))]
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), scores, *added)
