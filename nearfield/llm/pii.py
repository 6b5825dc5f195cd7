"""Personal data: expressions propose spans, checksums confirm them, words nearby move the score.

Everything is made of Spark SQL functions. Patterns are written so that Java's matcher runs
in linear time and constant stack on long runs: possessive groups where nothing can be given
back, and a match may begin only where a run begins or the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters looked at before a span for words that speak for or against its kind.
NEARBY = 40
#: What words for and against it add to a span's score, which ends at 1, and the score from which added kinds count.
FOR, AGAINST, THRESHOLD = 0.4, -0.3, 0.5
#: Matches summed at a time where offsets are made.
_GROUP = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # an expression; a text without it has no match
    score: float
    words: str  # nearby words that raise the score
    against: str = "order|invoice|isbn|issn|sku|serial|version|part no"  # nearby words that lower it


#: The kinds in the order in which spans that begin together are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|reach"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){11}[0-9]", 0.7, "card|visa|credit|payment|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.7, "iban|account|bank|transfer"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", 0.3, "ssn|social security|taxpayer|tax id"),
    Kind("local_phone", r"(?<![0-9(+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "[0-9]{3}[\x20.-][0-9]{4}", 0.3, "phone|tel|call|mobile|fax|whatsapp"),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,128}+={0,2}(?![A-Za-z0-9+/_=-])", "[A-Za-z0-9+/_-]{20}", 0.2, "token|secret|api.?key|access.?key|private.?key|password|passwd|bearer|credential", "sha-?1|sha-?256|md5|checksum|commit|digest"),
    Kind("key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72})(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "AKIA|gh[pousr]_|xox[abprs]-|PRIVATE KEY", 0.9, "key|token|secret", "example|sample|dummy"),
    Kind("password", r"(?i)(?<=password is |password: |password=|passwd=|passwd: |pwd=|pwd: )[^\s\"',;]{6,64}", "(?i)password|passwd|pwd", 0.6, "login|user|account", "example|sample|forgot|reset"),
)
BASE = tuple(k.name for k in KINDS[:4])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number, letters standing for 10 to 35, leaves 1 when divided by 97."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        v = F.when(c >= "A", F.ascii(c) - 55).otherwise(c.cast("int"))
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _holds(kind: Kind, m: Column) -> Column:
    if kind.name == "ip":
        return m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    if kind.name == "card":
        n = F.length(_digits(m))
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind.name == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind.name == "iban":
        return F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), mod97(m)).otherwise(False)
    if kind.name == "ssn":
        return m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    if kind.name == "secret":  # letters and digits mixed, not a word or a number
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 3)
    return F.lit(True)


_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _spans(text: Column, index: int, kind: Kind, threshold: float) -> Column:
    """The kind's confirmed spans: start and end in code points, end exclusive.

    Offsets are running sums of the lengths of matches and of the gaps between them, added up
    within groups of matches and over groups, so that thousands of matches stay cheap.
    """
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("text")))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _GROUP).cast("int")), lambda i: F.slice(pairs, i * _GROUP + 1, F.lit(_GROUP)))
    none = F.array().cast(_SPAN)

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(index).alias("kind"), (start + x["size"]).alias("end"), x["text"].alias("text"))
        return F.struct((start + x["size"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def group(state: Column, g: Column) -> Column:
        done = F.aggregate(g, F.struct(state["at"].alias("at"), none.alias("out")), place)
        return F.struct(done["at"].alias("at"), F.concat(state["outs"], F.array(done["out"])).alias("outs"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("outs"))
    placed = F.flatten(F.aggregate(groups, start, group)["outs"])
    some = F.filter(placed, lambda x: _holds(kind, x["text"]))
    there = text.rlike(kind.needs)
    if index >= len(BASE) and kind.score < threshold:  # only words nearby can bring it in
        there = text.rlike(f"(?i){kind.words}") & there
    return F.when(there & (F.size(matches) > 0), some).otherwise(none)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _of_kind(i: int) -> Column:
    return F.filter("found", lambda x: x["kind"] == i)


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, n_spans, n_secrets.

    email, ip, card and phone are base kinds and always stay. The other kinds are added if they pass their
    checks, lie in no base span and score at least `threshold`: a kind's own score, plus FOR if a word
    that bears it out stands among the NEARBY characters before the span, plus AGAINST if one that speaks
    against it does, 1 at most. Spans are kind:start:end in code points, by start, then in the order
    of KINDS; n_spans counts all, n_secrets secrets, keys and passwords. Null counts as empty; texts without
    spans give empty strings. Repeated rows keep a row each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumns({f"k{i}": _spans(F.col("text"), i, k, threshold) for i, k in enumerate(KINDS)})
    numbers = {k.name: i for i, k in enumerate(KINDS)}

    def score(x: Column) -> Column:
        before = F.substring(F.col("text"), F.greatest(x["start"] - NEARBY, F.lit(0)) + 1, F.least(x["start"], F.lit(NEARBY)))
        of_kind = lambda values: F.get(F.array(*[F.lit(v) for v in values]), x["kind"])
        near, against = of_kind([f"(?i){k.words}" for k in KINDS]), of_kind([f"(?i){k.against}" for k in KINDS])
        moved = F.when(F.regexp_like(before, near), FOR).otherwise(0.0) + F.when(F.regexp_like(before, against), AGAINST).otherwise(0.0)
        return F.round(F.least(of_kind([k.score for k in KINDS]) + moved, F.lit(1.0)), 2)

    def stays(x: Column) -> Column:
        inside = F.exists("base", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))
        return (x["kind"] < len(BASE)) | ((x["score"] >= threshold) & ~inside)

    every = F.array_sort(F.concat(*[F.col(f"k{i}") for i in range(len(KINDS))]))
    scored = F.transform(every, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "end")], score(x).alias("score")))
    rows = rows.select("doc_id", scored.alias("found")).withColumn("base", F.filter("found", lambda x: x["kind"] < len(BASE)))
    rows = rows.select("doc_id", "base", F.filter("found", stays).alias("found"))
    counts = [F.size(_of_kind(i)).cast("long").alias(f"n_{name}") for i, name in enumerate(BASE)]
    secrets = F.filter("found", lambda x: x["kind"].isin(numbers["secret"], numbers["key"], numbers["password"]))
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"),
        F.size("found").cast("long").alias("n_spans"),
        F.size(secrets).cast("long").alias("n_secrets"),
    )
