"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose candidate spans; five labelers vote on each, every one from a
fact of its own: the shape (a stricter pattern), a checksum or count, a
gazetteer of issuers, countries, endings or placeholders, words around it, and
its edges (of a secret: whether it is named).
Expectation-maximisation over the counts of vote patterns estimates the
labelers' reliabilities; and a logistic regression on votes, kind and length,
trained on the resulting soft labels, decides on the spans that no checked
pattern vouches for.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, whole_rows

#: Base kinds in the order in which spans of one start are listed.  Possessive
#: quantifiers match what plain ones do here, in constant stack; a match may
#: begin inside a run of its characters only where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that only the classifier can accept.
EXTRA = {
    "obfuscated_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[a-z0-9-]++ ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[a-z]{2,24}(?![a-z])",
    "local_phone": r"(?<![0-9+()-])(?<![0-9)] )(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": (
        r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+"
        r"|(?i:password|passwd|token|secret|api[_-]?key)(?:\x20?[=:]\x20?|\x20is\x20)\"?[A-Za-z0-9+/_-]{8,}+\"?"
        r"|(?<![/._@%+=-])(?:[A-Za-z]++[0-9]|[0-9]++[A-Za-z])[A-Za-z0-9]{14,}+(?![@/_%=-]|\.[A-Za-z0-9]))"
    ),
}
KINDS = [*BASE, *EXTRA]
#: What a text must contain for a kind's pattern to be tried.
GUARDS = {"email": "@", "phone": "+", "obfuscated_email": r"(?i)[(\[{ ]at[)\]} ]", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"AKIA|gh[pousr]_|sk-|[=:]|(?i: is )|[0-9][A-Za-z]|[A-Za-z][0-9]"}
DIGITS = "[0-9]"
#: Characters on either side of a span, up to the next match of its kind, that the context labeler reads.
CONTEXT = 40
#: Matches of a kind whose places are added up in one go.
STEP = 128
SHAPES = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,4}$",
    "obfuscated_email": r"(?i)(?:\[at\]|\(at\)|\{at\}).*(?:\[dot\]|\(dot\)|\{dot\})",
    "local_phone": r"^(?:\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}([-.])[0-9]{3}\1[0-9]{4})$",
    "national_id": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "iban": r"^[A-Z0-9]+$|^[A-Z0-9]{4}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$",
    "secret": r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_.*|sk-.*)$|(?:^|[=: ]\"?)(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]+\"?$",
}
#: Endings of mail domains, countries of bank accounts, calling codes, card issuers, and beginnings of issued keys.
DOMAINS = "com org net edu gov mil int info biz io co me tv app dev ai uk de fr es it nl ch at be eu us ca au jp cn in br ie pt pl se no dk fi cz gr ro hu ru ua tr il za mx ar cl nz kr sg hk example".split()
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 234 254 255 256 260 263"
    " 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998"
).split()
CARD_ISSUERS = "4 34 37 51 52 53 54 55 65 6011 2221 2720 3528 3589 36 38 62".split()
KEY_BEGINNINGS = "AKIA ghp_ gho_ ghu_ ghs_ ghr_ sk-".split()
PLACEHOLDERS = "change default demo dummy example expired hidden incorrect invalid missing optional placeholder redacted required sample test undefined unknown your xxx".split()
CUES = {
    "email": r"(?i)mail|contact|write|kontakt|schreib|courriel|correo|contacto",
    "ip": r"(?i)\bip\b|address|server|host|login|adresse|direcci",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay",
    "phone": r"(?i)phone|call|tel|fax|mobile|cell|anruf|appel|llam",
    "obfuscated_email": r"(?i)mail|contact|write|reach|kontakt|courriel|correo",
    "local_phone": r"(?i)phone|call|tel|fax|mobile|cell|anruf|appel|llam",
    "national_id": r"(?i)ssn|social|security|ident|number|nummer|num[eé]ro|n[uú]mero",
    "iban": r"(?i)iban|bank|account|konto|compte|cuenta",
    "secret": r"(?i)key|secret|credential|export|config|auth",
}
#: Hexadecimal digits of common digests: a bare string of such a length is known as a fingerprint.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: What stands before numbers of other sorts, and before fingerprints that look like secrets.
DIGESTS = r"(?i)(?:commit|revision|sha-?[0-9]{0,3}|md5|crc|checksum|digest|hash|etag|uuid|build|serial|order)\b[\W_]*(?:\w{1,4}\W+)?$"
AGAINST = r"(?i)(?:\bv|version|isbn|section|figure|page|chapter|§|#|\bno\.|kapitel|seite|p[aá]gina)\W*$"
LABELERS = ("shape", "valid", "gazetteer", "context", "edges")
EM_ROUNDS, ACCEPT = 60, 0.5


def _places(text: Column, kind: str) -> tuple[Column, Column]:
    """The kind's matches in text and the pieces between them."""
    pattern, guard = (BASE | EXTRA)[kind], GUARDS.get(kind, DIGITS)
    on = text.contains(guard) if kind in ("email", "phone") else text.rlike(guard)
    none = F.expr("cast(array() as array<string>)")
    return F.when(on, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))).otherwise(none), F.when(on, F.split(text, pattern, -1)).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    digits = _digits(text)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether the number that a bank account stands for leaves 1 at division by 97: its first four characters go last, letters count from 10."""
    clean = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(clean, F.lit(5), F.length(clean)), F.substring(clean, F.lit(1), F.lit(4)))

    def add(total: Column, c: Column) -> Column:
        return (F.when(F.ascii(c) >= 65, total * 100 + F.ascii(c) - 55).otherwise(total * 10 + F.ascii(c) - 48)) % 97

    return F.aggregate(F.split(turned, "", -1), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(add(t, c))) == 1


def secret_value(text: Column) -> Column:
    """What a secret consists of, without the name that it is assigned to and quotes."""
    return F.regexp_extract(text, r"([A-Za-z0-9+/_-]+)\"?$", 1)


def mixed(text: Column) -> Column:
    """Whether letters and digits take turns as in random strings: at least three times, and once in eight characters.  Words with a number do so once or twice."""
    turns = F.size(F.split(text, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1)) - 1
    return (turns >= 3) & (turns * 8 >= F.length(text))


def _issued(text: Column) -> Column:
    """Whether a secret begins as the keys of a known issuer do."""
    return _begins(secret_value(text), KEY_BEGINNINGS)


def _begins(text: Column, known: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.left(text, F.lit(n)).isin([k for k in known if len(k) == n]) for n in sorted(set(map(len, known)))])


def _valid(kind: str, text: Column) -> Column:
    """Whether a match passes its kind's check; null where a kind has none, and for issued keys, whose letters may well hold few digits."""
    n = F.length(_digits(text))
    return {
        "ip": F.forall(F.split(text, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)),
        "card": n.between(12, 19) & luhn(text),
        "phone": n.between(9, 15),
        "local_phone": text.rlike(r"^\(?[2-9][0-9]{2}[^0-9]{1,2}[2-9]"),
        "national_id": text.rlike(r"^(?!000|666|9)[0-9]{3}.(?!00)[0-9]{2}.(?!0000)"),
        "iban": mod97(text),
        "secret": F.when(mixed(secret_value(text)), True).when(~_issued(text), False),
    }.get(kind, F.lit(None).cast("boolean"))


def _listed(kind: str, text: Column) -> Column:
    """Whether a list of known instances holds what the match begins or ends with; null where a kind has no list, and for secrets of neither list."""
    digits = _digits(text)
    fingerprint = ~text.rlike("[=: ]") & text.rlike(f"^(?:{'|'.join(f'[0-9A-Fa-f]{{{n}}}' for n in DIGEST_LENGTHS)})$")
    ending = F.lower(F.regexp_extract(text, "[A-Za-z]+$", 0)).isin(DOMAINS)
    return {
        "email": ending, "obfuscated_email": ending, "iban": F.left(text, F.lit(2)).isin(IBAN_COUNTRIES), "phone": _begins(digits, CALLING_CODES), "card": _begins(digits, CARD_ISSUERS),
        "secret": F.when(_issued(text), True).when(fingerprint, False).when(F.lower(secret_value(text)).rlike(f"^(?:{'|'.join(PLACEHOLDERS)})"), False),
    }.get(kind, F.lit(None).cast("boolean"))


def _edges(kind: str, hit: Column, before: Column, after: Column) -> Column:
    """Whether the match stands free of letters and digits; of a secret, whether it is named, by what it is assigned to or by its own form (null in prose)."""
    if kind == "secret":
        return F.when(hit.rlike("[=:]") | _issued(hit), True).when(~hit.rlike(r"\x20"), False)
    return ~(F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") | F.left(after, F.lit(1)).rlike("[A-Za-z0-9]"))


def _vote(yes: Column) -> Column:
    """1, 0, or -1 for an abstention."""
    return F.coalesce(yes.cast("int"), F.lit(-1))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): all candidate spans of each row, by kind and start, with their votes.

    found is array<struct<kind, start, end, passed, LABELERS..., length>>;
    start and end count code points, passed tells whether a base kind's match
    passes its check.  Null texts count as empty and have none.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", *[c.alias(f"{kind}_{part}") for kind in KINDS for part, c in zip(("hits", "gaps"), _places(text, kind), strict=True)])
    none = F.expr("cast(array() as array<int>)")

    def starts(kind: str) -> Column:
        """Where each match begins.  Sums go on STEP by STEP matches, so that no long array is copied for each."""
        hits, gaps = F.col(f"{kind}_hits"), F.col(f"{kind}_gaps")

        def one(s: Column, i: Column) -> Column:
            first = s["at"] + F.length(F.get(gaps, i))
            return F.struct((first + F.length(F.get(hits, i))).alias("at"), F.array_append(s["starts"], first).alias("starts"))

        def block(s: Column, k: Column) -> Column:
            own = F.aggregate(F.sequence(k, F.least(k + STEP, F.size(hits)) - 1), F.struct(s["at"].alias("at"), none.alias("starts")), one)
            return F.struct(own["at"].alias("at"), F.array_append(s["blocks"], own["starts"]).alias("blocks"))

        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("blocks"))
        placed = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1, F.lit(STEP)), begin, block, lambda s: F.flatten(s["blocks"]))
        return F.when(F.size(hits) > 0, placed).otherwise(none)

    def judged(kind: str) -> Column:
        hits, gaps = F.col(f"{kind}_hits"), F.col(f"{kind}_gaps")

        def one(start: Column, i: Column) -> Column:
            hit = F.get(hits, i)
            before = F.right(F.concat(F.coalesce(F.right(F.get(hits, i - 1), F.lit(1)), F.lit("")), F.get(gaps, i)), F.lit(CONTEXT))
            after = F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.left(F.get(hits, i + 1), F.lit(1)), F.lit(""))), F.lit(CONTEXT))
            against = before.rlike(AGAINST) | before.rlike(DIGESTS) if kind == "secret" else before.rlike(AGAINST)
            cue = before.rlike(CUES[kind]) | after.rlike(CUES[kind])
            context = F.when(cue & ~against if kind == "secret" else cue, F.lit(1)).when(against, F.lit(0)).otherwise(F.lit(-1))
            valid = _valid(kind, hit)
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), F.coalesce(valid, F.lit(True)).alias("passed"), _vote(hit.rlike(SHAPES[kind])).alias("shape"), _vote(valid).alias("valid"),
                _vote(_listed(kind, hit)).alias("gazetteer"), context.alias("context"), _vote(_edges(kind, hit, before, after)).alias("edges"),
                F.least(F.floor(F.length(hit) / 8).cast("int"), F.lit(4)).alias("length"),
            )

        return F.transform(starts(kind), one)

    return rows.select("id", F.concat(*[judged(kind) for kind in KINDS]).alias("found"))


class SpanModel:
    """Labeler reliabilities by expectation-maximisation, and the span classifier trained on their verdicts."""

    def __init__(self, found: DataFrame):
        """found is what ``candidates`` returns.  Only counts of vote patterns, bounded by the number of possible patterns, reach the driver."""
        keys = ["kind", *LABELERS, "length"]
        scratch = Scratch(found.sparkSession, "pii-patterns")
        patterns = scratch.write(found.select(F.explode("found").alias("c")).select("c.*").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        rows = patterns.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).collect()
        self.kinds = sorted({r["kind"] for r in rows})
        self.weights: dict[tuple[str, object], float] | None = None
        if rows:
            self._estimate([(r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in rows])
            self._train(patterns)

    def _estimate(self, rows: list[tuple[str, tuple[int, ...], int]]) -> None:
        """Dawid and Skene: a span of each kind is personal with some prior; a labeler votes given the truth with its own reliability for that kind."""
        self.prior: dict[str, float] = {}
        self.evidence: dict[tuple[str, int, int], float] = {}
        for kind in self.kinds:
            own = [(votes, n) for k, votes, n in rows if k == kind]
            truth = [(0.5 + sum(v == 1 for v in votes)) / (1.0 + sum(v >= 0 for v in votes)) for votes, _ in own]
            for _ in range(EM_ROUNDS):
                prior = (1 + sum(p * n for p, (_, n) in zip(truth, own, strict=True))) / (2 + sum(n for _, n in own))
                self.prior[kind] = math.log(prior / (1 - prior))
                for j in range(len(LABELERS)):
                    mass = {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)} | {(1, 1): 4.0, (0, 0): 4.0}
                    for p, (votes, n) in zip(truth, own, strict=True):
                        mass[votes[j], 1] += p * n
                        mass[votes[j], 0] += (1 - p) * n
                    total = [sum(mass[v, y] for v in (-1, 0, 1)) for y in (0, 1)]
                    for v in (-1, 0, 1):
                        self.evidence[kind, j, v] = math.log(mass[v, 1] / total[1]) - math.log(mass[v, 0] / total[0])
                logits = [self.prior[kind] + sum(self.evidence[kind, j, v] for j, v in enumerate(votes)) for votes, _ in own]
                truth = [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in logits]

    def _train(self, patterns: DataFrame) -> None:
        logit = reduce(lambda a, b: a + b, [
            *(F.when(F.col("kind") == k, z).otherwise(0.0) for k, z in self.prior.items()),
            *(F.when((F.col("kind") == k) & (F.col(LABELERS[j]) == v), z).otherwise(0.0) for (k, j, v), z in self.evidence.items()),
        ])
        soft = patterns.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0)))))
        names = [*((x, v) for x in LABELERS for v in (0, 1)), *(("kind", k) for k in self.kinds), *(("length", b) for b in range(5))]
        inputs = [(F.col(x) == v).cast("double").alias(f"f{i}") for i, (x, v) in enumerate(names)]
        both = soft.select(F.lit(1.0).alias("label"), (F.col("p") * F.col("n")).alias("w"), *inputs).unionByName(soft.select(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("n")).alias("w"), *inputs))
        ready = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="x").transform(both.filter("w > 0"))
        model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=1e-3, standardization=False, maxIter=60).fit(ready)
        self.weights = dict(zip(names, map(float, model.coefficients), strict=True)) | {("", ""): float(model.intercept)}

    def accepts(self, c: Column) -> Column:
        """Whether the classifier takes a candidate struct for personal data."""
        if self.weights is None:
            return F.lit(False)
        z = reduce(lambda a, b: a + b, [F.when(c[x] == v, w).otherwise(0.0) if x else F.lit(w) for (x, v), w in self.weights.items()])
        return z >= math.log(ACCEPT / (1 - ACCEPT))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): array<struct<start, rank, kind, end>> of each row, sorted by start, then kind.

    A span of a base kind is in it if its match passes the kind's check.  A
    span of another kind is in it if the classifier accepts it and it overlaps
    no base span.  Null and empty texts have no spans; every row of docs,
    repeated or not, gives one row.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.write(candidates(docs, id_col, text_col))
    model = SpanModel(found.filter(F.size("found") > 0))
    base = F.filter("found", lambda c: c["kind"].isin(*BASE) & c["passed"])
    extra = F.filter("found", lambda c: c["kind"].isin(*EXTRA) & model.accepts(c))
    clear = F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    shaped = F.transform(F.concat("base", "extra"), lambda c: F.struct(c["start"].alias("start"), F.element_at(rank, c["kind"]).alias("rank"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.select("id", base.alias("base"), extra.alias("extra")).withColumn("extra", clear).select("id", F.array_sort(shaped).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of find_pii replaced by its kind in angle brackets.  Of overlapping spans the first counts.

    Rows are matched by id and text, so a repeated id with different texts is safe.
    """
    rows = whole_rows(docs, F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")).alias("row"), F.col(text_col).alias("text"))
    spans = find_pii(rows, "row", "text").filter(F.size("spans") > 0).groupBy(F.col("id").alias("row")).agg(F.first("spans").alias("spans"))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s: Column, p: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, p["start"] - s["at"])
        return F.when(p["start"] < s["at"], s).otherwise(F.struct(p["end"].alias("at"), F.concat(s["out"], F.array(gap, F.concat(F.lit("<"), p["kind"], F.lit(">")))).alias("out")))

    done = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    joined = rows.join(spans, "row", "left")
    return joined.select(*[(F.coalesce(done, text) if c.lower() == text_col.lower() else F.col("doc")[c]).alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op2_pii": op2_pii}
ORACLE_SQL: dict[str, str] = {}
