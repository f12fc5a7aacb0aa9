"""Personal data by weak supervision, in DataFrame functions only.

Candidates are what the patterns of each kind match, valid or not, and what looser patterns match. Labelers vote on each
(regex validity, structure, gazetteer, words of the context, borders); expectation maximisation over the counts of
vote patterns estimates how reliable each labeler is for each kind, and a logistic regression trained on the resulting
posteriors is the final span classifier. Spans of the base patterns always stay.

Texts are read once, whole, row by row. What is gathered is one count for each kind and pattern of votes, at most
4 x 3^5 rows whatever the data; the fitted weights go back as literals.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millpond.llm.common import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that Java finds the same matches in linear time: a run is entered at its start or where
# the last match ended, and never given back where nothing after it could use what it would give.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without a match of this cheaper test are not searched.
TESTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
LOOSE_TESTS = {"email": r"[\[(](?:at|AT)[\])]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
BEFORE = 40  # code points of context before a candidate
# Words near a candidate that speak for and against its kind.
FOR = {
    "email": "e-?mail|mail|contact|write|schreib|courriel|correo|adresse|address",
    "ip": r"\bip\b|address|host|server|login|from|client|adresse",
    "card": "card|visa|mastercard|amex|credit|payment|pay|karte|carte|tarjeta|iban|konto",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|ruf|anruf|appel|llam",
}
AGAINST = {
    "email": "example of|ssh|git clone",
    "ip": "version|release|section|chapter|kapitel|v$",
    "card": "isbn|order|serial|hash|token|key|id$|number of|version",
    "phone": "version|isbn|score|pages|chapter|price|range",
}
# Endings, issuers and country codes that are in use.
ENDINGS = r"(?i)\.(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|ch|at|be|pt|pl|se|no|dk|fi|ru|jp|cn|in|br|mx|au)$"
ISSUERS = "^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12})$"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
VOTES = 5
ROUNDS = 40
CANDIDATE = "array<struct<s:int,e:int,m:string>>"


def matches(text: Column, pattern: str, test: str) -> Column:
    """Matches with their places in code points: the pieces between matches and the matches in turn add up."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast(CANDIDATE).alias("out"))

    def step(a, x):
        s = a["at"] + F.length(x["piece"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        # The piece after the last match has none.
        one = F.when(x["m"].isNull(), F.expr("array()").cast(CANDIDATE)).otherwise(F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))))
        return F.struct(e.alias("at"), F.concat(a["out"], one).alias("out"))

    return F.when(F.contains(text, F.lit("@")) if test == "@" else F.rlike(text, F.lit(test)), F.aggregate(both, start, step, lambda a: a["out"])).otherwise(F.expr("array()").cast(CANDIDATE))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass; every second one from the right counts double, less nine if over nine."""
    each = F.filter(F.split(F.reverse(digits(m)), ""), lambda c: c != "")
    return F.aggregate(F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)), F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(m: Column) -> Column:
    """Whether all parts are at most 255; leading zeros do not count."""
    return F.forall(F.split(m, r"\."), lambda p: F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def valid(kind: str, m: Column) -> Column:
    """The base rule of a kind for a match of its pattern."""
    if kind == "ip":
        return small_parts(m)
    n = F.length(digits(m))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(m)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def votes(kind: str, strict: Column, m: Column, before: Column, after: Column) -> Column:
    """-1, 0 or 1 from each labeler."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    n = F.length(digits(m))
    shape = {
        "email": vote(F.rlike(m, F.lit("^[A-Za-z0-9]")), F.rlike(m, F.lit(r"^[._%+-]"))),
        "ip": vote(~F.rlike(m, F.lit(r"(?:^|\.)0[0-9]")), F.rlike(m, F.lit(r"[0-9]{4}"))),
        "card": vote(F.rlike(m, F.lit(r"^(?:[0-9]{15,16}|(?:[0-9]{4}[\x20-]){3}[0-9]{4})$")), (n < 12) | (n > 19)),
        "phone": vote(F.rlike(m, F.lit(r"[0-9][\x20).-]+[0-9]{3}[\x20.-][0-9]{2,4}")), (n < 9) | (n > 15)),
    }[kind]
    known = {
        "email": vote(F.rlike(m, F.lit(ENDINGS))),
        "ip": vote(F.rlike(m, F.lit(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.")), F.rlike(m, F.lit(r"^(?:0+\.|2[3-9][0-9]\.)"))),
        "card": vote(F.rlike(digits(m), F.lit(ISSUERS)), ~F.rlike(digits(m), F.lit(ISSUERS))),
        "phone": vote(F.rlike(m, F.lit(COUNTRIES))),
    }[kind]
    context = vote(F.rlike(before, F.lit(f"(?i)(?:{FOR[kind]})")), F.rlike(before, F.lit(f"(?i)(?:{AGAINST[kind]})")))
    border = vote(F.lit(False), F.rlike(before, F.lit(r"[A-Za-z0-9_\"=/]$")) | F.rlike(after, F.lit(r"^[A-Za-z0-9_\"/]")))
    return F.array(vote(strict, ~strict), shape, known, context, border)


def candidates(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep``, _base and _more: spans (s, k, e, votes) of the base patterns, and of what else may be personal data."""
    df = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias("_text"))
    text = F.col("_text")
    df = df.withColumns({f"_{k}": matches(text, PATTERNS[k], TESTS[k]) for k in KINDS} | {f"_loose_{k}": matches(text, LOOSE[k], LOOSE_TESTS[k]) for k in LOOSE})

    def judged(column: str, kind: str, strict) -> Column:
        def one(x):
            before = F.substring(text, F.greatest(x["s"] - BEFORE, F.lit(0)) + 1, F.least(x["s"], F.lit(BEFORE)))
            return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), votes(kind, strict(x["m"]), x["m"], before, F.substring(text, x["e"] + 1, F.lit(1))).alias("votes"))

        return F.transform(column, one)

    df = df.withColumn("_all", F.concat(*[judged(f"_{k}", k, lambda m, k=k: valid(k, m)) for k in KINDS]))
    df = df.withColumn("_loose", F.concat(*[judged(f"_loose_{k}", k, lambda m: F.lit(False)) for k in LOOSE]))
    df = df.withColumn("_base", F.filter("_all", lambda x: x["votes"][0] == 1))
    # A candidate that overlaps a base span or, if loose, any match is part of that.
    apart = lambda x, others: ~F.exists(others, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    df = df.withColumn("_more", F.concat(
        F.filter("_all", lambda x: (x["votes"][0] == -1) & (x["e"] - x["s"] >= 7) & apart(x, F.col("_base"))),
        F.filter("_loose", lambda x: apart(x, F.col("_all")))))
    return df.select(*[F.col(f"`{c}`") for c in keep], "_text", "_base", "_more")


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern of one kind, by expectation maximisation over two classes."""
    post = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v, _ in counts}
    for _ in range(ROUNDS):
        weight = {y: 1.0 + sum(n * (post[v] if y else 1 - post[v]) for v, n in counts) for y in (0, 1)}
        table = {}
        for y in (0, 1):
            for j in range(VOTES):
                for value in (-1, 0, 1):
                    seen = sum(n * (post[v] if y else 1 - post[v]) for v, n in counts if v[j] == value)
                    table[y, j, value] = (seen + 1.0) / (weight[y] + 2.0)
        for v, _ in counts:
            odds = math.log(weight[1] / weight[0]) + sum(math.log(table[1, j, v[j]] / table[0, j, v[j]]) for j in range(VOTES))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def classifier(counts: list[tuple[tuple[int, ...], int]], post: dict[tuple[int, ...], float], rounds: int = 300) -> list[float]:
    """Intercept, and the weight of each labeler's -1, 0 and 1, fitted to the posteriors by their counts."""
    w = [0.0] * (1 + 3 * VOTES)
    total = sum(n for _, n in counts) or 1
    for _ in range(rounds):
        grad = [0.0] * len(w)
        for v, n in counts:
            at = [0, *(1 + 3 * j + x + 1 for j, x in enumerate(v))]
            miss = n / total * (1 / (1 + math.exp(-sum(w[i] for i in at))) - post[v])
            for i in at:
                grad[i] += miss
        w = [a - 1.0 * (g + 1e-3 * a) for a, g in zip(w, grad)]
    return w


def train(found: DataFrame) -> dict[int, list[float]]:
    """Weights of each kind that has candidates, from what ``candidates`` returns."""
    every = found.select(F.explode(F.concat("_base", "_more")).alias("x")).groupBy(F.col("x.k").alias("k"), F.col("x.votes").alias("votes")).agg(F.count("*").alias("n"))
    counts: dict[int, list] = {}
    for r in sorted(every.collect(), key=lambda r: (r.k, r.votes)):
        counts.setdefault(r.k, []).append((tuple(r.votes), r.n))
    return {k: classifier(c, reliabilities(c)) for k, c in counts.items()}


def accepted(x: Column, weights: dict[int, list[float]]) -> Column:
    """Whether the classifier takes a candidate for personal data."""
    out = F.lit(False)
    for k, w in weights.items():
        z = F.lit(w[0])
        for j in range(VOTES):
            z = z + F.element_at(F.array(*[F.lit(v) for v in w[1 + 3 * j : 4 + 3 * j]]), x["votes"][j] + 2)
        out = F.when(x["k"] == k, z > 0).otherwise(out)
    return out


def spans(found: DataFrame) -> DataFrame:
    """Replace _base and _more by ``base`` and ``spans``: arrays of (s, k, e), by start and then kind."""
    weights = train(found)
    bare = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    base = bare(F.col("_base"))
    more = bare(F.filter("_more", lambda x: accepted(x, weights)))
    return found.withColumn("base", F.sort_array(base)).withColumn("spans", F.sort_array(F.array_distinct(F.concat(base, more)))).drop("_base", "_more")


def written(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of every row.

    A null text is an empty one: no spans, the digest of an empty text. Repeated rows are judged alike.
    """
    found = spans(stored(candidates(docs).drop("_text"), "pii"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets, and n_chars counted anew.

    Overlapping spans become the mark of the first. Null texts stay null.
    """
    # The row travels as one column, so none of its names can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    found = spans(stored(candidates(whole, ("_doc",)), "pii-mask"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        fresh = x["s"] >= a["at"]
        head = F.substring(F.col("_text"), a["at"] + 1, x["s"] - a["at"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(fresh, F.concat(a["out"], head, names[x["k"]])).otherwise(a["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.length("_text"))))
    found = found.withColumn("_clean", F.when(F.size("spans") > 0, clean))
    changed = F.size("spans") > 0
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean")}
    return found.select(*[
        F.when(changed, new[f.name].cast(f.dataType)).otherwise(F.col(f"_doc.`{f.name}`")).alias(f.name) if f.name in new else F.col(f"_doc.`{f.name}`").alias(f.name)
        for f in docs.schema.fields
    ])
