"""Personal data by weak supervision, in DataFrame expressions only.

Base spans come from fixed patterns with checks.  Beyond them, looser candidates are judged: labelers of three
sorts (regular expressions, gazetteers, context words) vote for, against, or not at all.  The votes are grouped
to patterns and counted; expectation-maximisation on that table (its size is bounded by the labelers, not by the
data) estimates how reliable each labeler is and how likely each pattern is personal data.  With those
probabilities as labels, a logistic classifier over features of the candidates is trained, and it decides.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

KINDS = ("email", "ip", "card", "phone", "id", "secret")

# The contract's patterns, written so that no start inside a run is tried in vain and no digit run recurses.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"  # shorter runs hold no card
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

# looser candidates
NUMBER = r"(?<![0-9A-Za-z.+-])[(]?[0-9]{2,4}[)]?(?:[ .-][(]?[0-9]{2,4}[)]?){1,5}(?![0-9A-Za-z])"
SECRET = r"(?i)(?:api[_-]?key|token|secret|passw(?:or)?d)[ ]{0,3}[:=][ ]{0,3}[\"']?[A-Za-z0-9+/=_-]{8,}+"
ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"

# gazetteers and context words
DOMAINS = "com|org|net|edu|gov|info|de|fr|es|uk|io"
PLACEHOLDERS = "example|changeme|your|xxx|test|null|none|dummy|placeholder"
PERSONAL_WORDS = "tel|phone|call|fax|mobile|contact|ssn|social|reach|mail|write|whatsapp"
OTHER_WORDS = "version|page|order|isbn|chapter|section|room|invoice|figure|table|year"
UNITS = "%|km|kg|cm|usd|eur|pages|items|years|percent"

#: matches whose places are gathered in one array before it joins the others
PLACES = 256

_SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
_NONE = f"cast(array() as {_SPAN})"


def located(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with places (code points) and the text around them.

    The gaps between the matches (a split by the same pattern) give the places."""
    def places(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                return F.struct((acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(found, i))).alias("at"),
                                F.array_append(acc["all"], acc["at"] + F.length(F.get(gaps, i))).alias("all"))

            def block(acc: Column, b: Column) -> Column:
                # appending copies an array, so places are gathered in blocks
                own = F.aggregate(F.sequence(b * PLACES, F.least(F.size(found), (b + 1) * PLACES) - 1),
                                  F.struct(acc["at"].alias("at"), F.expr("cast(array() as array<int>)").alias("all")), step)
                return let(own, lambda o: F.struct(o["at"].alias("at"), F.array_append(acc["all"], o["all"]).alias("all")))

            blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PLACES).cast("int"))
            begin = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("all")), block)["all"])
            return let(begin, lambda b: F.transform(found, lambda v, i: F.struct(
                F.get(b, i).alias("start"), (F.get(b, i) + F.length(v)).alias("end"), v.alias("value"),
                F.right(F.get(gaps, i), F.lit(24)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(12)).alias("right"))))
        return F.when(F.size(found) == 0, F.expr(_NONE)).otherwise(let(F.split(text, pattern, -1), with_gaps))

    got = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)
    return got if gate is None else F.when(gate, got).otherwise(F.expr(_NONE))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _card_ok(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))


def _entries(spans: Column, kind: str) -> Column:
    """(start, kind's place, end, kind) of spans."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"),
                                                 s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, k, end, kind) for the four base kinds."""
    has = lambda s: F.contains(text, F.lit(s))
    return {
        "email": _entries(located(text, EMAIL, has("@")), "email"),
        "ip": _entries(F.filter(located(text, IP), lambda s: F.rlike(s["value"], F.lit(IP_PARTS))), "ip"),
        "card": _entries(F.filter(located(text, CARD), lambda s: _card_ok(s["value"])), "card"),
        "phone": _entries(F.filter(located(text, PHONE, has("+")), lambda s: F.length(_digits(s["value"])).between(9, 15)), "phone"),
    }


# --------------------------------------------------------------------------- candidates, labelers, features

def candidates(text: Column) -> Column:
    """Array of (kind, start, end, value, left, right)."""
    def of(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "value", "left", "right")]))

    marked = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return F.concat(of("number", located(text, NUMBER)), of("secret", located(text, SECRET, marked)),
                    of("address", located(text, ADDRESS, F.rlike(text, F.lit(r"[(\[]at[)\]]")))))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))


def votes(c: Column) -> Column:
    """One character per labeler: + personal data, - not, 0 no opinion."""
    value, number, secret = F.lower(c["value"]), c["kind"] == "number", c["kind"] == "secret"
    n = F.length(_digits(value))
    has = lambda pattern, col=value: F.rlike(col, F.lit(pattern))
    left, right = F.lower(c["left"]), F.lower(c["right"])
    form = F.when(number, _vote(has(r"^[(]?\d{3}[)]?[ .-]\d{3}[ .-]\d{4}$") | has(r"^\d{3}-\d{2}-\d{4}$"), (n < 7) | (n > 15))) \
        .when(secret, _vote(has(r"[:=].*[0-9]") & has(r"[:=].*[a-z]"), has(r"[:=]\s*[\"']?[a-z_-]+$"))) \
        .otherwise(_vote(has(r"^[a-z0-9._%+-]+ ?[(\[]at[)\]]"), F.lit(False)))
    shape = F.when(number, _vote(F.lit(False), has(r"^(?:19|20)\d\d[ .-]\d\d[ .-]\d\d$") | has(r"^\d+(?:\.\d+)+$"))) \
        .when(secret, _vote(has(r"[:=]\s*[\"']?[0-9a-f]{24,}$") | has(r"[:=]\s*[\"']?[a-z0-9+/=_-]{32,}$"), F.length(value) < 18)) \
        .otherwise(_vote(has(r"[(\[]dot[)\]]"), F.lit(False)))
    gazetteer = F.when(number, _vote(has(r"^[(]?[2-9]\d{2}[)]?[ .-][2-9]\d{2}[ .-]\d{4}$"), has(r"^[(]?[01]"))) \
        .when(secret, _vote(F.lit(False), has(PLACEHOLDERS))) \
        .otherwise(_vote(has(rf"(?:\.|dot[)\]] ?)(?:{DOMAINS})$"), ~has(rf"(?:{DOMAINS})$")))
    before = _vote(has(rf"\b(?:{PERSONAL_WORDS})\b", left), has(rf"\b(?:{OTHER_WORDS})\b", left))
    after = _vote(has(r"^\s*(?:ext|x\d)", right) | (secret & has(r"^[\"']", right)), has(rf"^\s*(?:{UNITS})", right))
    return F.concat(form, shape, gazetteer, before, after)


LABELERS = 5
#: log odds from which the classifier takes a candidate
MIN_SCORE = 1.0


def features(c: Column) -> Column:
    """One character, 0 or 1, per feature of the candidate itself and its surroundings."""
    value = c["value"]
    n = F.length(_digits(value))
    has = lambda pattern, col=value: F.rlike(col, F.lit(pattern))
    bits = [n >= 7, n >= 10, n > 15, has(r"[()]"), has(r"-"), has(r"\."), F.length(value) > 24,
            has(r"\d{4}$"), has(r"[\"'=:]\s*$|\b[A-Za-z]{2,8}[.:]?\s*$", c["left"])]
    return F.concat(*[F.when(b, F.lit("1")).otherwise(F.lit("0")) for b in bits])


FEATURES = 9
CANDIDATE_KINDS = ("number", "secret", "address")
#: upper bound of the rows of the pattern table, whatever the data
MAX_PATTERNS = len(CANDIDATE_KINDS) * 3**LABELERS * 2**FEATURES


# --------------------------------------------------------------------------- training (on the pattern table)

Pattern = tuple[str, str, str, int]


def reliabilities(patterns: list[Pattern], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that a (kind, votes) pattern is personal data, by expectation-maximisation.

    Each labeler has, per kind and class, probabilities of its three votes; classes start at the vote balance."""
    rows: dict[tuple[str, str], int] = defaultdict(int)
    for kind, vote, _, n in patterns:
        rows[kind, vote] += n
    belief = {}
    for kind, vote in rows:
        balance = vote.count("+") - vote.count("-")
        belief[kind, vote] = 1 / (1 + math.exp(-1.5 * balance + 0.5))
    for _ in range(rounds):
        counts: dict = defaultdict(lambda: 0.5)
        prior: dict = defaultdict(lambda: 1.0)
        for (kind, vote), n in rows.items():
            for cls, p in ((1, belief[kind, vote]), (0, 1 - belief[kind, vote])):
                prior[kind, cls] += n * p
                for j, v in enumerate(vote):
                    # votes without opinion say little; silence is not evidence
                    counts[kind, j, cls, v] += n * p
        new = {}
        for kind, vote in rows:
            score = math.log(prior[kind, 1]) - math.log(prior[kind, 0])
            for j, v in enumerate(vote):
                if v == "0":
                    continue
                spoken = [counts[kind, j, cls, "+"] + counts[kind, j, cls, "-"] for cls in (0, 1)]
                score += math.log(counts[kind, j, 1, v] / spoken[1]) - math.log(counts[kind, j, 0, v] / spoken[0])
            new[kind, vote] = 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))
        moved = max((abs(new[k] - belief[k]) for k in new), default=0)
        belief = new
        if moved < 1e-9:
            break
    return belief


def train(patterns: list[Pattern], belief: dict[tuple[str, str], float], rounds: int = 400, penalty: float = 1.0) -> dict[str, list[float]]:
    """Logistic weights (bias first) per kind, fitted to the probabilities; gradient steps with a fixed rate."""
    weights = {}
    for kind in CANDIDATE_KINDS:
        own = [([1.0] + [float(b) for b in bits], belief[k, vote], n) for k, vote, bits, n in patterns if k == kind]
        w = [0.0] * (FEATURES + 1)
        total = sum(n for *_, n in own)
        for _ in range(rounds if own else 0):
            gradient = [penalty * x / total for x in w]
            for x, p, n in own:
                error = n / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x)))))) - p)
                gradient = [g + error * b for g, b in zip(gradient, x)]
            w = [a - 2.0 * g for a, g in zip(w, gradient)]
        weights[kind] = [round(x, 6) for x in w]
        if not own:
            weights[kind][0] = -1.0
    return weights


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, list[float]]:
    """Weights of the span classifier, from the candidates of all documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.explode(candidates(text)).alias("c")).select(
        F.col("c.kind").alias("kind"), votes(F.col("c")).alias("votes"), features(F.col("c")).alias("features"))
    table = each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted((r["kind"], r["votes"], r["features"], r["n"]) for r in table.collect())  # at most MAX_PATTERNS rows
    return train(patterns, reliabilities(patterns))


# --------------------------------------------------------------------------- spans

def _accepted(text: Column, weights: dict[str, list[float]], base: Column) -> Column:
    """Entries of the candidates the classifier takes and no base span touches; a secret is added around base spans
    inside it (digits of a key that pass as a card), unless one holds all of it."""
    def score(c: Column) -> Column:
        def of(bits: Column) -> Column:
            total = F.lit(None).cast("double")
            for kind, w in weights.items():
                value = F.lit(w[0])
                for j, x in enumerate(w[1:]):
                    value = value + F.when(F.substring(bits, j + 1, 1) == "1", F.lit(x)).otherwise(F.lit(0.0))
                total = F.when(c["kind"] == kind, value).otherwise(total)
            return total
        return let(features(c), of)

    kind = lambda c: F.when(c["kind"] == "secret", F.lit("secret")).when(c["kind"] == "address", F.lit("email")) \
        .when(F.rlike(c["value"], F.lit(r"^\d{3}-\d{2}-\d{4}$")), F.lit("id")).otherwise(F.lit("phone"))
    taken = F.filter(candidates(text), lambda c: (score(c) > MIN_SCORE) & ~F.exists(
        base, lambda s: F.when(c["kind"] == "secret", (s["start"] <= c["start"]) & (c["end"] <= s["end"]))
        .otherwise((s["start"] < c["end"]) & (c["start"] < s["end"]))))
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    return F.transform(taken, lambda c: let(kind(c), lambda k: F.struct(
        c["start"].alias("start"), F.element_at(place, k).alias("k"), c["end"].alias("end"), k.alias("kind"))))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, text_col: str = "text", name: str = "pii", weights: dict[str, list[float]] | None = None) -> DataFrame:
    """``docs`` with a struct column ``name``: ``base`` and ``spans`` (sorted arrays of start, k, end, kind; code points)
    and the counts n_email, n_ip, n_card, n_phone of the base spans.

    Null and empty texts have no spans; equal rows have equal spans; a text of any length is searched whole; an empty
    table stays empty; an input column ``name`` is replaced; other columns pass.  Without candidates in the table only
    base spans are found."""
    weights = fit(docs, text_col) if weights is None else weights
    docs = docs.drop(name) if name in docs.columns else docs
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("_base", F.struct(*[spans.alias(kind) for kind, spans in base_spans(text).items()]))
    base = [F.col(f"_base.{k}") for k in KINDS[:4]]
    found = found.withColumn("_spans", F.array_sort(F.concat(*base)))
    found = found.withColumn("_added", F.when(text == "", F.expr("cast(array() as array<struct<start:int,k:int,end:int,kind:string>>)"))
                             .otherwise(_accepted(text, weights, F.col("_spans"))))
    result = F.struct(F.col("_spans").alias("base"), F.array_sort(F.concat("_spans", "_added")).alias("spans"),
                      *[F.size(c).cast("bigint").alias(f"n_{k}") for k, c in zip(KINDS, base)])
    return found.withColumn(name, result).drop("_base", "_spans", "_added")


def digest(docs: DataFrame) -> DataFrame:
    p = F.col("pii")
    return find_personal_data(docs.select("doc_id", "text")).select(
        "doc_id", *[p[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:4]], F.sha2(_listing(p["base"]), 256).alias("base_sha256"),
        _listing(p["spans"]).alias("spans"))


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are one, named after the first."""
    name = "_pii"
    found = find_personal_data(docs, text_col, name)
    text = F.col(text_col)

    def masked(spans: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def add(acc: Column, s: Column) -> Column:
            gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            label = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
            return F.struct(F.concat(acc["out"], label).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    spans = F.col(name)["spans"]
    out = found.withColumn(text_col, F.when(F.size(spans) > 0, masked(spans)).otherwise(text)).drop(name)
    return out.withColumn("n_chars", F.length(text_col).cast("bigint")) if "n_chars" in docs.columns else out
