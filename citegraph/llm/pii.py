"""Personal data by weak supervision, in DataFrame operations only.

Regular expressions propose spans.  Each proposal gets votes from labelers: its
shape, a gazetteer, the words before it and the characters around it.
Expectation-maximisation estimates how reliable every labeler is, from nothing
but the number of spans of each vote pattern (a table of bounded size), and the
resulting soft labels train a naive Bayes classifier of spans.  What the base
rules find always stays; the classifier decides on the further proposals.

Where the spans stand: a match is put between marks, the text split at the marks,
and the lengths of the pieces summed up, so all of it is one narrow pass over the
texts without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.llm.shared import written

MARK, OTHER = "\x01", "\x02"
BASE = ("email", "ip", "card", "phone")
MORE = ("email_spelled", "phone_local", "national_id", "bank_account", "name", "secret")
KINDS = BASE + MORE

#: Whole runs are taken possessively, and a match starts where a run does or the last match ended: the same matches as the plain pattern, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSALS = {
    "email_spelled": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,64}){1,4}",
    "bank_account": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone_local": r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}",
    "name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
}
#: A proposal does not start within a word or number.
PROPOSAL = r"(?<![\p{L}0-9])(?:" + "|".join(PROPOSALS.values()) + ")"
#: The same for a text without a spelled-out at sign: every match begins with a capital, a digit or a bracket, which is quickly seen.
PLAIN = r"(?=[A-Z0-9(])(?<![\p{L}0-9])(?:" + "|".join(p for k, p in PROPOSALS.items() if k != "email_spelled") + ")"

_KEY = r"[A-Z\x20]{0,40}PRIVATE KEY-----"
#: Secrets: private keys, signed web tokens, quoted passwords, and runs of at least 16 characters with a letter and a digit.
SECRET = (
    rf"-----BEGIN {_KEY}[^-]*+-----END {_KEY}"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
    r"|(?<=[\"'])(?<=(?i:password|passwd|passphrase|pwd)[\"']?\x20{0,2}[:=]\x20{0,2}[\"'])[^\"'\s]{4,64}+(?=[\"'])"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}"
)
#: How the secrets of well-known issuers begin.
ISSUED = "AKIA ASIA AIza ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- npm_ sk- sk_live_ sk_test_ rk_live_ xoxa- xoxb- xoxp- eyJ -----BEGIN".split()

GIVEN_NAMES = "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna maria peter paul hans klaus jürgen sabine pierre jean marie françois sophie luis carlos josé juan carmen elena lucía".split()
DOMAINS = "com org net edu gov de fr es uk eu io info".split()
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE".split()
CONTEXT = {
    "email": "mail|e-mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|address|server|login|adresse|dirección",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta|payment",
    "phone": "tel|phone|call|fax|mobile|telefon|téléphone|teléfono",
    "email_spelled": "mail|e-mail|contact|write|kontakt|correo|courriel",
    "phone_local": "tel|phone|call|fax|mobile|telefon|téléphone|teléfono",
    "national_id": "ssn|social|security|id|number|nummer|sécurité|seguridad",
    "bank_account": "iban|account|bank|konto|compte|cuenta",
    "secret": "token|secret|password|passwd|passphrase|pwd|key|apikey|auth|authorization|bearer|credential|credentials",
    "name": "dear|contact|name|signed|by|liebe|lieber|sehr|geehrter|geehrte|cher|chère|estimado|estimada",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,62}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,61}\.)+[A-Za-z]{2,24}$",
    "ip": r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$",
    "card": r"^[3-6]",
    "phone": r"^\+[1-9]",
    "email_spelled": r"^[A-Za-z0-9._%+-]+\x20?[\[(]at[\])].*[A-Za-z]{2,24}$",
    "phone_local": r"^\(?[2-9][0-9]{2}\)?[\x20.-]*[2-9]",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "bank_account": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){3,7}(?:\x20[A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{13,32}$",
    "name": r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9_+-]{20,}={0,2}|[^/]*[^A-Za-z0-9_+/=-](?s:.*))$",
}
LABELERS, LENGTHS, ROUNDS = 4, 4, 12
#: Weight, in spans, of what is assumed of the labelers beforehand.
PRIOR = 20
CHUNK = 64


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once however often a lambda in `body` asks for it."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, pattern: str, guard: Column) -> Column:
    """The text cut at its matches: n code points each, what a match says, and the ends of what lies between matches; null without a match."""
    cut = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    parts = F.transform(cut, lambda p, i: F.struct(F.length(p).alias("n"), F.when(i % 2 == 1, p).alias("m"), F.left(p, F.lit(1)).alias("l"), F.right(p, F.lit(40)).alias("r")))
    return F.when(guard & F.regexp_like(text, F.lit(pattern)), parts)


def _starts(pieces: Column) -> Column:
    """Where each piece starts: running sums over chunks of pieces, so that no long array is copied for each piece."""
    none = F.array().cast("array<bigint>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda c: F.slice(pieces, c * CHUNK + 1, CHUNK))

    def one(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
        return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out")), one)["out"])


def _spans(pieces: Column) -> Column:
    """Array of (start, end, m, before, after) of the matches; empty without any."""
    kind = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"

    def at(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
            lambda i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.get(pieces, i)["n"]).alias("end"), F.get(pieces, i)["m"].alias("m"), F.get(pieces, i - 1)["r"].alias("before"), F.get(pieces, i + 1)["l"].alias("after")),
        )

    return F.coalesce(F.when(F.size(pieces) >= 3, let(_starts(pieces), at)), F.array()).cast(kind)


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _luhn(m: Column) -> Column:
    def passes(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            digit = F.substring(d, i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 1, digit).when(digit >= 5, digit * 2 - 9).otherwise(digit * 2)

        return F.when(F.length(d).between(13, 19), F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0).otherwise(False)

    return let(F.reverse(F.regexp_replace(m, "[^0-9]", "")), passes)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.regexp_like(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    "card": _luhn,
    "phone": lambda m: _digits(m).between(9, 15),
}


def _by_kind(kind: Column | str, table: dict[str, Column], default: Column) -> Column:
    if isinstance(kind, str):
        return table.get(kind, default)
    out = F.when(F.lit(False), default)
    for k, v in table.items():
        out = out.when(kind == k, v)
    return out.otherwise(default)


def _vote(kind: Column | str, s: Column) -> Column:
    """The pattern of a span: the bits of shape, gazetteer, context and surroundings, and its length in four steps."""
    m = s["m"]
    shape = _by_kind(kind, {k: F.regexp_like(m, F.lit(p)) for k, p in STRICT.items()}, F.lit(False))
    named = {
        "email": F.regexp_like(m, F.lit(r"\.(?:" + "|".join(DOMAINS) + ")$")), "email_spelled": F.regexp_like(m, F.lit(r"(?:" + "|".join(DOMAINS) + ")$")),
        "bank_account": F.left(m, F.lit(2)).isin(COUNTRIES), "name": F.regexp_like(F.lower(m), F.lit(r"\b(?:" + "|".join(GIVEN_NAMES) + r")\b")),
        "secret": F.regexp_like(m, F.lit("^(?:" + "|".join(ISSUED) + ")")),
        "secret": F.regexp_like(m, F.lit("^(?:" + "|".join(ISSUED) + ")")),
    }
    gazetteer = _by_kind(kind, named, F.lit(False))
    context = _by_kind(kind, {k: F.regexp_like(F.lower(s["before"]), F.lit(rf"(?<!\p{{L}})(?:{w})[^\p{{L}}]*$")) for k, w in CONTEXT.items()}, F.lit(False))
    apart = ~F.regexp_like(F.right(s["before"], F.lit(1)), F.lit(r"[\p{L}0-9@#_-]")) & ~F.regexp_like(s["after"], F.lit(r"[\p{L}0-9@#_-]"))
    bits = [F.coalesce(x, F.lit(False)).cast("int") * (1 << i) for i, x in enumerate((shape, gazetteer, context, apart))]
    step = F.least(F.lit(LENGTHS - 1), F.floor(F.length(m) / 10).cast("int"))
    return bits[0] + bits[1] + bits[2] + bits[3] + step * (1 << LABELERS)


def proposals(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of `docs` (text, ...) with base and more: arrays of (kind number, start, end, pattern), the valid base spans by kind and start, and the further proposals: secrets that lie within no other span, others that touch no base span."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    text = docs.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], F.when(F.contains(raw, F.lit(MARK)), F.translate(raw, MARK, OTHER)).otherwise(raw).alias("text"))
    t = F.col("text")
    guards = {"email": F.contains(t, F.lit("@")), "ip": F.contains(t, F.lit(".")), "card": F.lit(True), "phone": F.contains(t, F.lit("+"))}
    spelled = F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)"))
    cut = written(
        text.select(*[F.col(f"__keep_{c}").alias(c) for c in keep], *[_pieces(t, PATTERNS[k], guards[k]).alias(f"__{k}") for k in BASE], F.when(spelled, _pieces(t, PROPOSAL, F.lit(True))).otherwise(_pieces(t, PLAIN, F.lit(True))).alias("__more"), _pieces(t, SECRET, F.lit(True)).alias("__secret")), "pieces"
    )

    kind = "array<struct<kind:int,start:bigint,end:bigint,pattern:int>>"

    def found(k: str) -> Column:
        number = BASE.index(k)
        good = F.filter(_spans(F.col(f"__{k}")), lambda s: VALID[k](s["m"]))
        return F.transform(good, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _vote(k, s).alias("pattern")))

    def which(s: Column) -> Column:
        out = F.lit("phone_local")
        for k in ("name", "phone_local", "national_id", "bank_account", "email_spelled"):
            out = F.when(F.regexp_like(s["m"], F.lit(f"^(?:{PROPOSALS[k]})$")), F.lit(k)).otherwise(out)
        return out

    def further(base: Column) -> Column:
        free = F.filter(_spans(F.col("__more")), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        typed = F.transform(free, lambda s: let(which(s), lambda k: F.struct(_by_kind(k, {x: F.lit(KINDS.index(x)) for x in MORE}, F.lit(KINDS.index("phone_local"))).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _vote(k, s).alias("pattern"))))

        def secrets(others: Column) -> Column:
            alone = F.filter(_spans(F.col("__secret")), lambda s: ~F.exists(F.concat(base, others), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
            return F.transform(alone, lambda s: F.struct(F.lit(KINDS.index("secret")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _vote("secret", s).alias("pattern")))

        return F.struct(base.alias("base"), let(typed.cast(kind), lambda others: F.array_sort(F.concat(others, secrets(others).cast(kind)))).alias("more"))

    # Most rows have no span at all; nothing is computed for those.
    some = F.coalesce(*[F.col(f"__{k}").isNotNull() for k in BASE])
    for k in (*BASE, "more", "secret"):
        some = some | F.col(f"__{k}").isNotNull()
    all_found = F.when(some, let(F.concat(*[found(k) for k in BASE]).cast(kind), further))
    out = cut.select(*keep, all_found.alias("__found"))
    return out.select(*keep, F.coalesce(F.col("__found.base"), F.array().cast(kind)).cast(kind).alias("base"), F.coalesce(F.col("__found.more"), F.array().cast(kind)).cast(kind).alias("more"))


def estimate(counts: dict[tuple[int, int], int], rounds: int = ROUNDS) -> list[float]:
    """The classifier's probability of each (kind, pattern), flat, from how many spans have it.

    For each kind: expectation-maximisation of a two-class model with independent
    labelers, then a naive Bayes classifier over votes and length, trained on the
    soft labels.  PRIOR spans of each class whose votes are right three times in four are
    added, so that the classes cannot change places and a kind without spans has a
    classifier too.
    """
    out = []
    for kind in range(len(KINDS)):
        own = [([p >> i & 1 for i in range(LABELERS)], p >> LABELERS, n) for (k, p), n in sorted(counts.items()) if k == kind]
        soft = [(sum(votes) + 0.5) / (LABELERS + 1) for votes, *_ in own]
        for _ in range(rounds + 1):
            sums = []
            for c in (0, 1):
                weights = [n * (p if c else 1 - p) for (*_, n), p in zip(own, soft, strict=True)]
                total = sum(weights) + PRIOR
                votes = [(sum(w for w, (v, *_) in zip(weights, own, strict=True) if v[i]) + PRIOR * (0.75 if c else 0.25)) / total for i in range(LABELERS)]
                steps = [(sum(w for w, (_, s, _) in zip(weights, own, strict=True) if s == step) + PRIOR / LENGTHS) / total for step in range(LENGTHS)]
                sums.append((total, votes, steps))

            def probability(votes: list[int], step: int | None, sums=sums) -> float:
                odds = math.log(sums[1][0] / sums[0][0])
                for i, v in enumerate(votes):
                    yes, no = sums[1][1][i], sums[0][1][i]
                    odds += math.log(yes / no) if v else math.log((1 - yes) / (1 - no))
                if step is not None:
                    odds += math.log(sums[1][2][step] / sums[0][2][step])
                return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))

            soft = [probability(v, None) for v, *_ in own]
        out += [probability([p >> i & 1 for i in range(LABELERS)], p >> LABELERS) for p in range((1 << LABELERS) * LENGTHS)]
    return out


def fit(found: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """`estimate` over all spans of `found`, counted by kind and pattern: a table of len(KINDS) * 2**LABELERS * LENGTHS rows at most, whatever the corpus."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s"))
    counts = spans.groupBy("s.kind", "s.pattern").agg(F.count("*").alias("n")).collect()
    return estimate({(r["kind"], r["pattern"]): r["n"] for r in counts}, rounds)


def personal_data(docs: DataFrame, *keep: str, least: float = 0.5) -> DataFrame:
    """The columns `keep` of `docs` (text, ...) with base and added: arrays of (kind, start, end, probability) in code points, end exclusive.

    base are the matches of the base rules that pass their checks, always; added
    are further spans, apart from those, to which the classifier gives at least
    `least`.  A null or empty text has none.  Repeated rows are judged alike; which
    other columns there are, null or not, makes no difference; an empty table gives an empty one.
    """
    found = written(proposals(docs, *keep), "spans")
    table = F.array(*[F.lit(float(p)) for p in fit(found)])
    size = (1 << LABELERS) * LENGTHS
    names = F.array(*[F.lit(k) for k in KINDS])

    def judged(table: Column, spans: str) -> Column:
        return F.transform(spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.get(table, s["kind"] * size + s["pattern"]).alias("probability")))

    base = F.when(F.size("base") > 0, let(table, lambda t: judged(t, "base"))).otherwise(F.array())
    added = F.when(F.size("more") > 0, F.filter(let(table, lambda t: judged(t, "more")), lambda s: s["probability"] >= least)).otherwise(F.array())
    kind = "array<struct<kind:string,start:bigint,end:bigint,probability:double>>"
    return found.select(*keep, base.cast(kind).alias("base"), added.cast(kind).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """n_email, n_ip, n_card, n_phone, base_sha256 and spans beside the other columns of what personal_data returns."""
    others = [c for c in found.columns if c not in ("base", "added")]
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(*others, *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
