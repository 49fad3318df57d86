"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Kinds, in order: email, ip, card, phone (the base kinds, whose spans always
stay), then iban (mod 97), ssn, and secret (keys and tokens), which stay from a score of `min_score`. Spans are code points, end
exclusive, leftmost and non-overlapping for each kind. A null or empty text has no spans; an empty table gives
no rows; repeated rows each give their own; texts are matched whole, however long.

The patterns never scan a run of letters or digits twice (possessive quantifiers, look-behind), so long
unsplit texts cost linear time. Positions come from the lengths of what lies between the matches, added
up in blocks of `BLOCK`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
BLOCK = 256
NEAR = 40

# A match starts where a run starts, or right where the match before it ended (\\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score before its context; words within NEAR code points before or after a span, up to the next match of its kind, add 0.3.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.4}
#: Words in English, German, French and Spanish.
CONTEXT = {
    "email": "mail|contact|kontakt|courriel|correo",
    "ip": "address|host|server|\\bip\\b|adresse|serveur|servidor|direcci[oó]n",
    "card": "card|visa|credit|payment|karte|kredit|zahlung|carte|cr[eé]dit|paiement|tarjeta|\\bpago",
    "phone": "phone|call|tel|mobile|fax|handy|rufnummer|t[eé]l[eé]|appel|llama|m[oó]vil",
    "iban": "iban|account|bank|konto|compte|banque|cuenta|banco",
    "ssn": "ssn|social security|sozialversicherung|s[eé]curit[eé] sociale|seguridad social",
    "secret": "token|secret|password|passwd|credential|bearer|\\bkey|[_-]key|api.?key|schl[uü]ssel|passwor[td]|geheim|mot de passe|cl[eé] |jeton|contrase|clave|secreto",
}
MIN_SCORE = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    code = F.replace(match, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4))), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def _part_fits(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, "\\."), _part_fits),
    "card": lambda m: _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(m),
    "ssn": lambda m: ~m.startswith("000") & ~m.startswith("666") & ~m.startswith("9"),
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
}


def _before(lengths: Column, i: Column) -> Column:
    """Sum of the first i lengths."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    whole = F.floor(i / BLOCK).cast("int")
    return total(F.slice(blocks, F.lit(1), whole)) + total(F.slice(lengths, whole * BLOCK + 1, i - whole * BLOCK))


def _near(gaps: Column, i: Column, kind: str) -> Column:
    """Whether the text on either side, up to the next match of the kind, holds a word of the kind."""
    before, after = F.right(F.get(gaps, i), F.lit(NEAR)), F.left(F.get(gaps, i + 1), F.lit(NEAR))
    return F.lower(before).rlike(CONTEXT[kind]) | F.lower(after).rlike(CONTEXT[kind])


def _span(no: int, kind: str, gaps: Column, lengths: Column):
    """Match and place in the matches -> its span."""

    def span(match: Column, i: Column) -> Column:
        start = _before(lengths, i) + F.length(F.get(gaps, i))
        near = _near(gaps, i, kind)
        return F.struct(
            start.alias("start"),
            F.lit(no).alias("kind_no"),
            (start + F.length(match)).alias("end"),
            F.lit(kind).alias("kind"),
            F.round(F.lit(SCORES[kind]) + F.when(near, 0.3).otherwise(0.0), 2).alias("score"),
            VALID[kind](match).alias("valid"),
        )

    return span


def detect(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """`row` and `spans`: array of (start, kind_no, end, kind, score), by start, then kind as listed."""
    names = docs.columns if keep is None else keep
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        need = F.col("text").contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        # one column each, so that none is worked out twice
        out = out.withColumn(f"m_{kind}", F.when(need, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))))
    for kind in KINDS:
        matches = F.col(f"m_{kind}")
        gaps = F.split("text", PATTERNS[kind], -1)
        out = out.withColumn(f"g_{kind}", F.when(F.size(matches) > 0, gaps))
    for kind in KINDS:
        matches, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
        out = out.withColumn(f"l_{kind}", F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
    for no, kind in enumerate(KINDS):
        # gaps are null where nothing matched
        found = F.transform(F.col(f"m_{kind}"), _span(no, kind, F.col(f"g_{kind}"), F.col(f"l_{kind}")))
        stays = (lambda x: x["valid"]) if kind in BASE else (lambda x: x["valid"] & (x["score"] >= min_score))
        out = out.withColumn(f"s_{kind}", F.when(F.col(f"g_{kind}").isNotNull(), F.filter(found, stays)))
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double,valid:boolean>>")
    return out.select("row", F.sort_array(F.concat(*[F.coalesce(F.col(f"s_{k}"), empty) for k in KINDS])).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")



def scored(spans: Column) -> Column:
    """The spans' scores in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.format_string("%.2f", x["score"])), ",")
