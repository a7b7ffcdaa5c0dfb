"""Personal data, with DataFrame functions only.

Regular expressions propose spans; checksum validators (Luhn for card numbers,
mod-97 for bank account numbers) and range checks confirm them; context words
near a span adjust its score, which decides on spans beyond the base: a long run
of letters and digits is a secret only where a word such as "token" stands near.

Positions come from one pair of built-ins over the same expression:
``regexp_extract_all`` gives the matches and ``split`` the gaps between them, so
running sums of their lengths are the matches' starts, in code points.

The expressions are written for linear time on very long texts: a repeated
class is possessive, and a match may begin only where its first class does (or
where the match before ended), which leaves leftmost matches as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order of the listing; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "account")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"[A-Za-z0-9_-]{20,}+",
    "account": r"[0-9]++",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
#: A character without which a text holds no match: such texts are not searched.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Score of a match before its context is read, and words that raise it when they stand within ``NEAR`` characters.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "secret": 0.5, "account": 0.5}
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|address|host|server", "card": "card|visa|credit|payment|karte|carte|tarjeta",
           "phone": "phone|call|tel|fax|mobile", "iban": "iban|bank|account|konto|compte|cuenta",
           "secret": "token|secret|passw|credential|bearer|api[ _-]?key|access[ _-]?key|private[ _-]?key",
           "account": "account|konto|compte|cuenta|passport|tax id|social security"}
NEAR, RAISE = 40, 0.2
#: Added kinds need this score; base spans stay whatever theirs is. Those that
#: begin below it (a run of letters and digits may be anything) pass only with a context word near.
LEAST_SCORE = 0.7
BY_CONTEXT = tuple(k for k in KINDS if SCORES[k] < LEAST_SCORE and k not in BASE)

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    last = F.length(number)

    def add(total, i):
        d = F.substring(number, last - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), last - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Does a bank account number (capitals and digits, no blanks) leave 1 when
    its first four characters go to the end and letters count from 10?"""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def add(rest, c):
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.regexp_extract_all(moved, F.lit("(.)"), F.lit(1)), F.lit(0), add) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        number = digits(match)
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    if kind == "account":
        return F.length(match).between(8, 17)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, score) of one kind, by start."""
    pattern, context = PATTERNS[kind], CONTEXT[kind]
    none = "array<struct<kind:string,start:int,end:int,score:double>>"

    def placed(found):
        matches = found["matches"]
        gaps = F.transform(found["gaps"], lambda g: F.length(g))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        # the last span made is the running state: its end is where the next gap begins
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int>>").alias("spans"))

        def add(state, p):
            at = state["at"] + p["gap"]
            span = F.array(F.struct(p["match"].alias("match"), at.alias("start")))
            # only confirmed matches are kept, so that the state stays short
            return F.struct((at + F.length(p["match"])).alias("at"),
                            F.when(_confirmed(kind, p["match"]), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        spans = F.aggregate(pairs, start, add, lambda s: s["spans"])

        def scored(s):
            end = s["start"] + F.length(s["match"])
            begin = F.greatest(s["start"] - NEAR, F.lit(0))
            near = F.lower(F.concat(F.substring(text, begin + 1, s["start"] - begin), F.lit(" "), F.substring(text, end + 1, F.lit(NEAR))))
            score = F.lit(SCORES[kind]) + F.when(near.rlike(context), RAISE).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        spans = F.transform(spans, scored)
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    made = _let(found, placed).cast(none)
    if kind in BY_CONTEXT:  # without a context word anywhere no match can pass
        return F.when(F.lower(text).rlike(context), made).otherwise(F.array().cast(none))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), made).otherwise(F.array().cast(none)) if kind in NEEDS else made


def find(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """Every row with ``pii``: array of (kind, start, end, score), by kind as
    listed, then start; code points, end exclusive. Null texts count as empty;
    an input column ``pii`` is replaced; other columns, repeated rows and empty
    tables pass as they are. Texts of any length are searched whole, in their row."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c != "pii"]
    text = common.text_of(text_column)
    return documents.select(*rest, _let(text, lambda t: F.concat(*[_spans(k, t) for k in KINDS])).alias("pii"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(documents: DataFrame, text_column: str = "text", least: float = 0.0) -> DataFrame:
    """The rows with every span of at least that score replaced by <KIND>.
    Of overlapping spans the first counts, the longer of two that begin together."""
    spans = F.array_sort(F.filter("pii", lambda s: s["score"] >= least),
                         lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = common.text_of(text_column)

    def add(state, s):
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(
            s["end"].alias("at"), F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]),
                                           F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    out = F.aggregate(spans, start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return find(documents.drop("pii"), text_column).withColumn(text_column, out)
