"""Personal data: pattern proposals, checksum confirmation, context scores -- built-in functions only.

The context of a span is the text on both sides up to the next match of its kind, CONTEXT_CHARS at most.

A kind is a pattern, a check on the matched string and a base score. Positions come from
the pieces between matches (``split``) and the matches (``regexp_extract_all``): a span
starts where the pieces and matches before it end, in code points. Patterns are written
with possessive quantifiers and run-start anchors: they accept the leftmost greedy
matches of the plain patterns but never rescan a run, so a text of one endless run stays linear.

Defined results: a null text is an empty one; an empty text has no span; spans of
different kinds may overlap; repeated rows give equal rows; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import unpack, with_row_struct

_LOCAL = r"[A-Za-z0-9._%+-]"

# length of a bank account number (IBAN) by country code: the registry, then codes in use outside it
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def iban_patterns() -> tuple[str, str]:
    """Account numbers in one run or in groups of four, as long as their country has them: what
    follows (a code, a year) is not taken in. A group that begins such a number itself ends the one
    before. Second, the same for codes without a known length: 15 to 34 characters, as far as they go."""
    end = r"(?![A-Za-z0-9])"

    def known(group):
        by_length = []
        for n, codes in IBAN_LENGTHS.items():
            groups, tail = divmod(n - 4, 4)
            spaced = rf"(?:\x20{group}[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20{group}[A-Z0-9]{{{tail}}}" if tail else "")
            by_length.append(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|{spaced}){end}")
        return "(?:" + "|".join(by_length) + ")"
    new = f"(?!{known('')})"
    codes = " ".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = rf"(?!{codes})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?:\x20{new}[A-Z0-9]{{4}}){{2,7}}(?:\x20{new}[A-Z0-9]{{1,3}})?){end}"
    start = "(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])"  # tested before the alternatives: few places pass
    return start + known(new), start + other


_IBAN, _IBAN_OTHER = iban_patterns()
_ACCOUNT = "iban|bank|account|konto|compte|cuenta"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str | None      # a text without this character has no match (cheap test before the pattern)
    score: float
    context: str           # words near a span that raise its score
    threshold: float = 0.0


# plain forms of the patterns:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+    ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                phone \+[0-9][\x20().0-9-]+[0-9]
# A card match is a maximal run of digits, so runs of other lengths need not match at all.
# "\G" lets a match begin inside a run right after the one before it.
KINDS = (
    Kind("email", r"(?:\G|(?<!" + _LOCAL + r"))" + _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8,
         "mail|email|e-mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", None, 0.7, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "tel|phone|call|mobile|telefon|fax"),
    # added by the method: bank account numbers, confirmed by mod 97
    Kind("iban", _IBAN, None, 0.7, _ACCOUNT, 0.5),
    # no country with this code is known: a checksum alone is not enough, the context decides
    Kind("iban_other", _IBAN_OTHER, None, 0.4, _ACCOUNT, 0.5),
)
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2


def _digits(m: Column) -> Column:
    return F.translate(m, " ().+-", "")


def luhn(digits: Column) -> Column:
    """Sum of a number of up to 19 digits: zeros on the left change nothing."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(19):
        d = F.substring(padded, i + 1, 1)
        total = total + (d if i % 2 == 0 else F.translate(d, "0123456789", "0246813579")).cast("int")
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """The first four characters moved behind the rest, letters read as 10..35: remainder 1."""
    s = F.translate(account, " ", "")
    s = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    rest = F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(
        c <= "9", (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def confirmed(kind: str, m: Column) -> Column:
    """Checksum and range tests on a matched string."""
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind in ("iban", "iban_other"):
        return mod97(m)
    return F.lit(True)


def _matches(text: Column, k: Kind) -> tuple[Column, Column]:
    """Matched strings and the pieces around them (one more); the cheap test comes first."""
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    parts = F.split(text, k.pattern, -1)
    if k.needs is None:
        return found, parts
    has = F.contains(text, F.lit(k.needs))
    return (F.when(has, found).otherwise(F.array().cast("array<string>")),
            F.when(has, parts).otherwise(F.array(text)))


def _near(before: Column, after: Column) -> Column:
    """The context of a match between two pieces."""
    return F.lower(F.concat_ws(" ", F.right(before, F.lit(CONTEXT_CHARS)), F.left(after, F.lit(CONTEXT_CHARS))))


def _score(k: Kind, near: Column) -> Column:
    return F.lit(k.score) + F.when(near.rlike(rf"\b(?:{k.context})\b"), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))


_SPAN = "array<struct<start:int,end:int,s:string,near:string>>"


_GROUP = 256  # matches whose positions are added up in one inner array


def _positions(found: Column, parts: Column) -> Column:
    """(start, end, matched string) of every match, in order: running sums by groups, so that a
    text with very many matches does not copy one long array per match."""
    def step(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s"), x["near"].alias("near"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    def group(acc, members):
        done = F.aggregate(members, F.struct(acc["pos"].alias("pos"), F.array().cast(_SPAN).alias("out")), step)
        return F.transform(F.array(done), lambda r: F.struct(
            r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    sides = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), F.slice(parts, F.lit(2), F.size(found)),
                       lambda before, after: F.struct(F.length(before).alias("gap"), _near(before, after).alias("near")))
    gaps = F.zip_with(sides, found, lambda a, m: F.struct(a["gap"].alias("gap"), m.alias("m"), a["near"].alias("near")))
    groups = F.transform(F.array(gaps), lambda g: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(g) - 1) / _GROUP).cast("int")),
        lambda i: F.slice(g, i * _GROUP + 1, _GROUP)))[0]
    empty = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(
        F.aggregate(groups, empty, group, lambda acc: F.flatten(acc["out"])))


def spans(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``row`` and one array column per kind: (start, end, s, score) of every confirmed span
    whose score reaches the kind's threshold (0 for the base kinds: they always stay)."""
    d = with_row_struct(docs)
    d = d.select("row", F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text"))
    cols = []
    for k in kinds:
        found, parts = _matches(F.col("text"), k)
        cols += [found.alias(f"m_{k.name}"), parts.alias(f"p_{k.name}")]
    d = d.select("row", "text", *cols)
    d = d.select("row", *[_positions(F.col(f"m_{k.name}"), F.col(f"p_{k.name}")).alias(k.name) for k in kinds])
    def scored(k: Kind):
        good = F.filter(F.col(k.name), lambda x: confirmed(k.name, x["s"]))
        with_score = F.transform(good, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
            _score(k, x["near"]).alias("score")))
        return F.filter(with_score, lambda x: x["score"] >= k.threshold)
    return d.select("row", *[scored(k).alias(k.name) for k in kinds])


def _listed(kinds: list[str]) -> Column:
    def named(k):
        return F.transform(F.col(k), lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"),
                                                           x["end"].cast("string")))
    return F.concat_ws(",", F.flatten(F.array(*[named(k) for k in kinds])))


def op8(docs: DataFrame) -> DataFrame:
    found = spans(docs)
    base = ["email", "ip", "card", "phone"]
    scores = F.transform(F.flatten(F.array(*[F.col(k.name) for k in KINDS])), lambda x: F.round(x["score"], 2))
    return found.select(F.col("row.doc_id").alias("doc_id"),
                        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                        _listed([k.name for k in KINDS]).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The input with every span of ``spans`` replaced by ``<KIND>``, kind after kind (a later
    kind sees the text the earlier ones left; kinds that need their context come first, so they see
    it as ``spans`` does); a null text stays null. ``n_chars``, if there, is the new length; all
    other columns are unchanged."""
    def shown(k: Kind) -> Column:
        label = F.lit(f"<{k.name.upper()}>")
        marked = F.transform("found", lambda m: F.when(confirmed(k.name, m), label).otherwise(m))
        if k.score < k.threshold:
            n = F.size("found")
            sides = F.zip_with(F.slice("parts", F.lit(1), n), F.slice("parts", F.lit(2), n), _near)
            marked = F.zip_with("found", sides, lambda m, near: F.when(
                confirmed(k.name, m) & (_score(k, near) >= k.threshold), label).otherwise(m))
        return F.array_join(F.zip_with("parts", marked, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    d = with_row_struct(docs).select("row", F.col("row").getField(text_col).alias("text"))
    for k in sorted(kinds, key=lambda k: k.score >= k.threshold):
        found, parts = _matches(F.col("text"), k)
        d = d.select("row", "text", found.alias("found"), parts.alias("parts"))
        d = d.select("row", F.when(F.size("found") > 0, shown(k)).otherwise(F.col("text")).alias("text"))
    out = unpack(d.select(F.col("row").withField(text_col, F.col("text")).alias("row")), docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
