"""Personal data by regular expressions, checksums and context words, in DataFrame functions only.

Patterns propose spans (code points, end exclusive); Luhn and mod-97 confirm card and IBAN numbers; words in the 40
characters before and after a span raise its score. Base kinds (email, ip, card, phone) keep every span that passes its own test; the kinds the
method adds (iban, ssn, secret) stay if their score reaches the limit.

Positions come from three native calls a kind: ``split`` gives the gaps between the matches and ``regexp_extract_all`` the
matches and what follows each, so a span's start is the length of all before it. Patterns are possessive and anchored at the start of a run,
so that a text of one very long run is read in linear time; the matches are those of the plain patterns.

What runs over a text's spans goes by blocks of about the square root of their number, since a step that appends to an
array or a text copies it: a text of n spans costs about n to the power 1.5.

Defined results: null and empty texts have no spans; repeated rows and tied ids are rows of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigengine.llm.common import let

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
KINDS = BASE + ADDED

#: Length of an IBAN by its country: the registry of ISO 13616 and the countries that use the format without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An IBAN as long as its country says, so that what follows cannot join it; of an unlisted country, the whole run."""
    known = "|".join(x.replace(" ", "|") for x in IBAN_LENGTHS.values())
    rest = r"[0-9]{2}(?:\x20?+[A-Z0-9])"
    each = [rf"(?:{x.replace(' ', '|')}){rest}{{{n - 4}}}+" for n, x in IBAN_LENGTHS.items()]
    return rf"(?:{'|'.join(each)}|(?!{known})[A-Z]{{2}}{rest}{{11,30}}+)(?![A-Za-z0-9])"


# Fixed patterns. Leading look-behinds (or \G, the end of the match before) only skip starts that cannot match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9]){_iban()}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
}
#: A cheap test without which no span of the kind can be.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-"),
    "secret": lambda t: F.contains(t, F.lit("AKIA")),
}
#: Words about a span that make its kind likelier.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|address|server",
    "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security",
    "secret": "key|secret|token|aws",
}
START = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.4, "secret": 0.8}


@dataclass(frozen=True)
class PiiParams:
    context_chars: int = 40
    context_gain: float = 0.2
    checksum_gain: float = 0.3
    least_score: float = 0.6  # of the added kinds


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def total(d: Column) -> Column:
        n = F.length(d)
        value = lambda i: F.substr(d, n - i, F.lit(1)).cast("int")
        return F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.lit(0),
            lambda acc, i: acc + F.when(i % 2 == 1, value(i) * 2 - F.when(value(i) > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(value(i)),
        )

    return F.when(F.length(digits) > 0, total(digits) % 10 == 0).otherwise(F.lit(False))


def mod97(iban: Column) -> Column:
    """Whether a number of capitals and digits passes the mod-97 test of IBANs."""

    def rest(s: Column) -> Column:
        moved = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
        return F.aggregate(
            F.filter(F.split(moved, ""), lambda c: F.length(c) > 0),
            F.lit(0),
            lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
        )

    return rest(F.replace(iban, F.lit(" "), F.lit(""))) == 1


def _grouped(kind: str, after: int) -> str:
    """The kind's pattern with the span as group 1 and up to ``after`` characters that follow it as group 2.

    Of an IBAN only the first four characters are consumed: what looks like one cannot hide one that begins within it.
    """
    follows = rf"((?s:.{{0,{after}}}))"
    if kind == "iban":
        return rf"(?<![A-Za-z0-9])(?=({_iban()}){follows})[A-Z]{{2}}[0-9]{{2}}"
    return rf"({PATTERNS[kind]})(?={follows})"


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _proposed(kind: str, text: Column, params: PiiParams) -> Column:
    """array<struct<kind, s, e, score>> of the kind's spans that pass, by start."""

    def placed(x: Column) -> Column:
        gaps, found = x["gaps"], x["found"]
        parts = F.zip_with(
            F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))),
            x["after"],
            lambda y, a: F.struct(
                y["gap"].alias("gap"),
                F.length(y["gap"]).alias("g"),
                (F.lit(4) if kind == "iban" else F.length(y["m"])).alias("n"),
                y["m"].alias("m"),
                a.alias("after"),
            ),
        )
        none_yet = F.array().cast("array<struct<s:int,e:int,about:string>>")
        empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit("").alias("last"), none_yet.alias("spans"))
        last = lambda *texts: F.right(F.concat(*texts), F.lit(params.context_chars))

        def step(acc: Column, p: Column) -> Column:
            s = acc["at"] + p["g"]
            e = s + F.length(p["m"])
            taken = (s >= acc["end"]) & _passes(kind, p["m"])
            about = F.lower(F.concat_ws("\n", last(acc["last"], p["gap"]), p["after"]))
            return F.struct(
                (s + p["n"]).alias("at"),
                F.when(taken, e).otherwise(acc["end"]).alias("end"),
                last(acc["last"], p["gap"], F.left(p["m"], p["n"])).alias("last"),
                F.when(taken, F.concat(acc["spans"], F.array(F.struct(s.alias("s"), e.alias("e"), about.alias("about"))))).otherwise(acc["spans"]).alias("spans"),
            )

        def block(acc: Column, b: Column) -> Column:
            fresh = F.struct(acc["at"].alias("at"), acc["end"].alias("end"), acc["last"].alias("last"), none_yet.alias("spans"))
            return let(F.aggregate(b, fresh, step), lambda y: F.struct(y["at"].alias("at"), y["end"].alias("end"), y["last"].alias("last"), F.concat(acc["blocks"], F.array(y["spans"])).alias("blocks")))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit("").alias("last"), F.array().cast("array<array<struct<s:int,e:int,about:string>>>").alias("blocks"))
        spans = let(parts, lambda v: F.when(F.size(v) <= 256, F.aggregate(v, empty, step)["spans"]).otherwise(F.flatten(F.aggregate(_blocks(v), start, block)["blocks"])))
        checked = params.checksum_gain if kind in ("card", "iban") else 0.0
        return F.transform(
            spans,
            lambda y: F.struct(
                F.lit(kind).alias("kind"),
                y["s"].alias("s"),
                y["e"].alias("e"),
                F.least(F.lit(1.0), F.lit(START[kind] + checked) + F.when(y["about"].rlike(CONTEXT[kind]), F.lit(params.context_gain)).otherwise(F.lit(0.0))).alias("score"),
            ),
        )

    none = F.array().cast("array<struct<kind:string,s:int,e:int,score:double>>")
    pattern = _grouped(kind, params.context_chars)
    matches = F.struct(F.split(text, pattern).alias("gaps"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(name) for i, name in ((1, "found"), (2, "after"))])
    out = F.when(GATES[kind](text), let(matches, placed)).otherwise(none)
    return F.filter(out, lambda x: x["score"] >= params.least_score) if kind in ADDED else out


def _blocks(v: Column) -> Column:
    """An array cut into arrays of about the square root of its size."""
    size = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
    return F.transform(F.sequence(F.lit(1), F.size(v), size), lambda i: F.slice(v, i, size))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii", params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with a struct column ``out_col``, which replaces one of that name: one array of spans for each kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out_col, F.struct(*[_proposed(k, text, params).alias(k) for k in KINDS]))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PiiParams = PiiParams()) -> DataFrame:
    """One row a document: counts of the base kinds, digest of the base spans, all spans and their scores."""
    d = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), params=params).select("doc_id", *[F.col(f"pii.{k}").alias(k) for k in KINDS])
    every = F.concat(*[F.col(k) for k in KINDS])
    return d.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.concat(*[F.col(k) for k in BASE])), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.array_join(F.transform(every, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """The text with marks for its spans (s, e, kind), which are sorted; those that overlap become the first one's mark."""
    # the end covered so far, for each span: spans that begin before it are dropped
    none_yet = F.array().cast("array<struct<s:int,e:int,kind:string,at:int>>")

    def cover(acc: Column, x: Column) -> Column:
        own = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), acc["at"].alias("at"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        return let(F.aggregate(b, F.struct(acc["at"].alias("at"), none_yet.alias("out")), cover), lambda y: F.struct(y["at"].alias("at"), F.concat(acc["out"], F.array(y["out"])).alias("out")))

    covered = F.aggregate(_blocks(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,kind:string,at:int>>>").alias("out")), block)

    def pieces(x: Column) -> Column:
        def of_block(b: Column) -> Column:
            # characters are found by walking from the start, so a block's part of the text is cut out once
            lo = b[0]["at"]
            part = F.substr(text, lo + 1, F.get(b, F.size(b) - 1)["e"] - lo)
            return let(part, lambda t: F.array_join(F.transform(b, lambda y: F.concat(F.substr(t, y["at"] - lo + 1, y["s"] - y["at"]), F.lit("<"), F.upper(y["kind"]), F.lit(">"))), ""))

        filled = F.filter(x["out"], lambda b: F.size(b) > 0)
        return F.concat(F.array_join(F.transform(filled, of_block), ""), F.substr(text, x["at"] + 1, F.length(text)))

    return let(covered, pieces)


def mask_pii(docs: DataFrame, text_col: str = "text", params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans that overlap become the first one's mark."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = F.concat(*[_proposed(k, text, params) for k in KINDS])
    spans = F.array_sort(F.transform(every, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), s["kind"].alias("kind"))))
    whole = let(F.struct(text.alias("text"), spans.alias("spans")), lambda x: F.when(F.size(x["spans"]) > 0, _masked(x["text"], x["spans"])).otherwise(x["text"]))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), whole))
