"""Personal data by weak supervision, in DataFrame functions only.

Patterns give candidate spans, true and false ones.  Five labelers vote on each (1: personal, -1: not, 0: no opinion): a
check of the value (sums, lengths, dates), gazetteers (names, banks, countries, domains, placeholders), words of the context for and
against, the borders of the span, and its shape.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind; the posteriors train a final span classifier, naive Bayes on soft
counts of hashed features (neighbouring words, shape and length of the value) that starts from the log odds of the votes.
It is trained REFINEMENTS times, each time on its own last opinion, so that words which labelers don't know come to count.
Spans of the base kinds always stay; other kinds stay if the classifier says so.

Positions are code points, ends exclusive.  Null and empty texts have no spans.  Spans of one kind don't overlap; those of
different kinds may.  Repeated rows count each.  All that reaches the driver are counts by vote pattern (at most
3**5 for each kind) and by feature (at most FEATURES for each kind).  Columns of the caller pass, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import gazetteers as G
from ledgerline.llm.common import cut, pack

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account", "iban", "person", "address")
LOCAL = "A-Za-z0-9._%+-"
SECRET_KEY = r"(?:token|api[_-]?key|secret|password|passwd|pwd)\x20?[=:]\x20?\x22?"
_NAME, _START, _STOP = r"\p{Lu}[\p{Ll}'-]{1,24}", r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Leftmost matches; those of the base kinds are the contract's.  A run is only tried from its start (or from the end of a match), and
#: quantifiers are possessive where nothing that follows could take characters back, or bounded: so long runs take linear time.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?i)(?<![A-Za-z0-9]){SECRET_KEY}[A-Za-z0-9+/_.-]{{8,}}+\x22?",
    "iban": rf"{_START}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?{_STOP}",
    "person": rf"{_START}(?=\p{{Lu}})(?:(?:{'|'.join(G.TITLES)})\.?\x20{_NAME}(?:\x20{_NAME}){{0,2}}|(?:{'|'.join(G.GIVEN)})\x20{_NAME}(?:\x20{_NAME})?){_STOP}",
    "address": rf"{_START}(?:[0-9]{{1,5}}\x20(?:{_NAME}\x20){{1,3}}(?:{'|'.join(G.STREETS)})|\p{{Lu}}[\p{{Ll}}-]{{1,24}}(?:{'|'.join(G.STREET_ENDS)})\x20[0-9]{{1,4}}[a-z]?"
    rf"|[0-9]{{1,5}},?\x20(?:{'|'.join(G.STREETS_BEFORE)})\x20(?:(?:de|du|des|la|le|les)\x20){{0,2}}{_NAME}|(?:{'|'.join(G.STREETS_BEFORE)})\x20(?:(?:de|del|la|las|los)\x20){{0,2}}{_NAME},?\x20[0-9]{{1,5}}){_STOP}",
}
#: What a text must have for the pattern to be worth trying.
NEEDS = {"email": "@", "phone": "+"}
CONTEXT = 40
#: Words of the context that speak for a kind, and against it.
CUES = {
    "email": "mail|contact|write|kontakt|adresse|correo", "ip": r"\bip\b|host|server|login|client|visitor", "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|cell|anruf|appel|llam", "secret": "config|export|auth|login|header|curl|environment", "account": "account|konto|compte|cuenta|acct",
    "iban": "iban|bank|konto|account|transfer|überweis|virement|cuenta|bic", "person": r"\bname|born|signed|dear|contact|patient|customer|kunde|geboren|client|nació|née?\b",
    "address": "address|lives?\\b|deliver|ship to|resid|adresse|wohn|habite|vive|dirección|domicil",
}
AGAINST = {
    "email": "noreply|invalid", "ip": "version|release|section|chapter", "card": "order|tracking|isbn|serial|invoice|ticket", "phone": "isbn|serial|part no",
    "secret": "example|placeholder|sample|documentation", "account": "order|tracking|isbn|serial|invoice|ticket|timestamp|bestell|commande|pedido",
    "iban": "part|serial|model|order|license|product", "person": "beach|airport|brand|drink|museum|company|club|hotel", "address": "percent|banks|traders|index|stocks|protest",
}
#: Numbers that test systems are given.  Fixed values.
TEST_CARDS = "4111111111111111 4242424242424242 4012888888881881 5555555555554444 5105105105105100 378282246310005 371449635398431 6011111111111117"
LABELERS = 5
#: Hashed features of each kind.
FEATURES = 512
ROUNDS = 60
REFINEMENTS = 3
#: A span of another kind stays from these log odds on (two to one): where nothing speaks for it or against it, it goes.
LEAST_ODDS = math.log(2)
#: Before any vote is seen, a labeler is right in so many of 1; that counts as so many votes, and as this share of the kind's candidates.
RIGHT, LEAST_VOTES, PRIOR_SHARE = 0.8, 5.0, 0.1
#: Added to each soft count of the classifier.
SMOOTHING = 0.5
STEP = 256

CANDIDATE = "array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>"


def _spans(df: DataFrame, name: str, pattern: str, need: str | None) -> DataFrame:
    """df with column `name`: array of (start, value) of the pattern's matches in _text.

    The text is split at the matches; starts are running sums of lengths, by blocks of STEP, so that many matches
    don't take quadratic time.
    """
    t = F.col("_text")
    pieces, values, lens, offs = (f"_{x}_{name}" for x in ("pieces", "values", "lens", "offs"))
    split = F.split(t, pattern, -1)
    df = df.withColumn(pieces, F.when(t.contains(need), split).otherwise(F.array(t)) if need else split)
    # The text itself is not needed if nothing was found.
    found = F.when(F.size(pieces) > 1, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(values, found)
    df = df.withColumn(lens, F.transform(values, lambda v, i: F.length(v) + F.length(F.get(F.col(pieces), i))))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(lens) / STEP).cast("int")),
        lambda k: F.aggregate(F.slice(F.col(lens), k * STEP + 1, STEP), F.lit(0), lambda s, v: s + v),
    )
    df = df.withColumn(offs, F.aggregate(blocks, F.array(F.lit(0)), lambda s, v: F.array_append(s, F.element_at(s, -1) + v)))

    def place(v, i):
        k = F.floor(i / STEP).cast("int")
        within = F.aggregate(F.slice(F.col(lens), k * STEP + 1, i % STEP), F.lit(0), lambda s, x: s + x)
        return F.struct((F.get(F.col(offs), k) + within + F.length(F.get(F.col(pieces), i))).alias("start"), v.alias("value"))

    return df.withColumn(name, F.transform(values, place)).drop(pieces, values, lens, offs)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _sound(kind: str, value: Column) -> Column:
    """Whether a match is a candidate."""
    if kind == "ip":
        # Numbers of at most 255, whatever zeros lead.
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "account"):
        n = F.length(_digits(value))
        luhn = F.call_function("luhn_check", _digits(value))
        return n.between(13, 19) & (luhn if kind == "card" else ~luhn)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda s: _sound(kind, s["value"])


def _in_context(k: int):
    def full(s):
        n, t, start = F.length(s["value"]), F.col("_text"), s["start"]
        return F.struct(
            F.lit(k).alias("kind"), start.alias("start"), (start + n).alias("end"), s["value"].alias("value"),
            t.substr(F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))).alias("left"), t.substr(start + n + 1, F.lit(CONTEXT)).alias("right"),
        )

    return full


def candidates(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`doc` (the columns `carry` of docs) and `cands`: spans by kind as in KINDS, then by start, with their contexts."""
    df = pack(docs, carry, _text=text).withColumn("_text", F.coalesce(F.col("_text").cast("string"), F.lit("")))
    for name, pattern in PATTERNS.items():
        df = _spans(df, f"_{name}", pattern, NEEDS.get(name))
    parts = []
    for k, kind in enumerate(KINDS):
        sound = F.filter(F.col(f"_{'card' if kind == 'account' else kind}"), _keeps(kind))
        parts.append(F.transform(sound, _in_context(k)).cast(CANDIDATE))
    return df.select("doc", F.concat(*parts).alias("cands"))


def _by_kind(kind: Column, votes_: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, name in reversed(list(enumerate(KINDS))):
        out = F.when(kind == k, votes_[name]).otherwise(out)
    return out


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN, its first four characters last and letters as two digits."""
    raw = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(raw, F.lit(5)), F.left(raw, F.lit(4)))

    def step(left, c):
        code = F.ascii(c)
        return F.pmod(F.when(code >= 65, left * 100 + code - 55).otherwise(left * 10 + code - 48), F.lit(97))

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _word(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.").replace("*", r"\*") for w in words)


def votes(c: Column) -> list[Column]:
    """The labelers' votes on a candidate.

    What the pattern of a kind grants already (a form, a border) is no evidence for it: there a labeler only votes against.
    """
    vote = lambda yes, no=-1: F.when(yes, 1).otherwise(no)
    value, kind, left, right = c["value"], c["kind"], c["left"], c["right"]
    digits, nought = _digits(value), F.lit(0)
    own = F.regexp_replace(value, rf'(?i)^{SECRET_KEY}|"$', "")  # a secret without its key
    bare = F.replace(value, F.lit(" "), F.lit(""))
    lengths = F.create_map(*(F.lit(x) for pair in G.IBAN_LENGTHS.items() for x in pair))
    number = r"(?<![0-9])[1-9][0-9]{0,3}(?![0-9])"
    check = _by_kind(kind, {
        "email": vote(value.rlike(r"\.[A-Za-z]{2,}$")), "ip": vote(~value.rlike(r"^(0+|127|255|22[4-9]|2[3-4][0-9])\.|^[0-9](\.[0-9]){3}$")),
        "card": vote(digits.rlike("^(4[0-9]{12}([0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(011|5[0-9]{2})[0-9]{12,15})$")), "phone": vote(digits.rlike("^(1[0-9]{10}|[2-9][0-9]{8,13})$")),
        "secret": F.when(own.rlike("[0-9]") & own.rlike("[A-Za-z]") & (F.length(own) >= 16), 1).when(~own.rlike("[0-9]"), -1).otherwise(0),
        "account": F.when(digits.rlike(r"^(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])|([0-9])\4{6}|12345678"), -1).otherwise(0), "iban": vote(_mod97(value) == 1),
        "person": vote(value.rlike(rf"^({_word(G.TITLES)})\b"), 0), "address": vote(~value.rlike(number), 0) * -1,
    })
    known = _by_kind(kind, {
        "email": vote(value.rlike(rf"(?i)\.({_word(G.TOP_DOMAINS)})$")), "ip": vote(value.rlike(r"^(10|192\.168|172\.(1[6-9]|2[0-9]|3[01])|192\.0\.2|198\.51\.100|203\.0\.113)\."), 0) * -1,
        "card": vote(digits.isin(*TEST_CARDS.split()), 0) * -1, "phone": vote(digits.rlike(f"^({_word(G.DIALLING)})")),
        "secret": F.when(F.lower(own).rlike(_word(G.PLACEHOLDERS)), -1).when(own.rlike(f"^({_word(G.ISSUERS)})"), 1).otherwise(0),
        "account": vote(F.lower(F.concat_ws(" ", left, right)).rlike(rf"\b({_word(G.BANKS)})\b"), 0), "iban": vote(F.coalesce(F.try_element_at(lengths, F.left(value, F.lit(2))) != F.length(bare), F.lit(True)), 0) * -1,
        "person": F.when(value.rlike(f"\\x20({_word(G.NO_SURNAMES)})$"), -1).when(value.rlike(rf"\b({_word(G.GIVEN)})\b"), 1).otherwise(0),
        "address": vote(right.rlike(r"^[,\s]+([A-Z]{1,2}[- ])?[0-9]{4,5}\b"), 0),
    })
    cue = F.lower(F.concat_ws(" ", left, right))
    context = _by_kind(kind, {n: F.when(cue.rlike(AGAINST[n]), -1).when(cue.rlike(CUES[n]), 1).otherwise(nought) for n in KINDS})
    glued = left.rlike(r"[A-Za-z0-9_/]$") | right.rlike("^[A-Za-z0-9_/@]")
    borders = _by_kind(kind, {n: F.when(glued, -1).otherwise(F.lit(1) if n in BASE else nought) for n in KINDS})
    shape = _by_kind(kind, {
        "email": vote(value.rlike("^[A-Za-z0-9][^@]{0,63}@")), "ip": vote(value.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")), "card": vote(value.rlike("^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$")),
        "phone": vote(value.rlike(r"^\+[0-9]{1,3}[ (.-]")), "secret": vote(own.rlike("(?i)^[0-9a-f]{16,}$|^(?=.*[0-9])(?=.*[A-Z])[A-Za-z0-9+/_.-]{20,}$")), "account": vote(value.rlike("^[0-9]{4}([ -][0-9]{4}){2}"), 0),
        "iban": vote(~value.rlike(r"^[A-Z0-9]+$|^[A-Z0-9]{4}(\x20[A-Z0-9]{4})+(\x20[A-Z0-9]{1,3})?$"), 0) * -1, "person": vote(value.rlike(r"\x20\S{1,2}$"), 0) * -1, "address": vote(value.rlike("[0-9]{5}"), 0) * -1,
    })
    return [check, known, context, borders, shape]


def features(c: Column) -> Column:
    """Hashed features of a candidate: length, shape of the whole value, and the words beside it; a range of numbers for each kind."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(c["value"], "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    word = lambda text, pattern: F.lower(F.regexp_extract(text, pattern, 1))
    parts = [
        F.concat(F.lit("n"), F.least(F.length(c["value"]), F.lit(40)).cast("string")), F.concat(F.lit("s"), shape),
        F.concat(F.lit("l"), word(c["left"], r"([^\s]*)\s*$")), F.concat(F.lit("r"), word(c["right"], r"^\s*([^\s]*)")),
    ]
    return F.array(*((c["kind"] * FEATURES + F.pmod(F.xxhash64(p), F.lit(FEATURES))).cast("int") for p in parts))


def vote_patterns(found: DataFrame) -> DataFrame:
    """found with `spans` in place of cands: kind, start, end, the vote pattern in base 3, and features."""

    def one(c):
        pattern = sum(((v + 1) * 3**i for i, v in enumerate(votes(c))), F.lit(0)).cast("int")
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), pattern.alias("pattern"), features(c).alias("features"))

    return found.select("doc", F.transform("cands", one).alias("spans"))


def expectation_maximisation(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], list[tuple[float, float]], float]:
    """Of one kind, from counts by vote pattern: the posterior by pattern, how often each labeler is right on
    personal and on other spans, and the share of personal spans.

    The belief that labelers are mostly right grows with the counts: without it, candidates that all have the same votes
    could become personal or not as well.
    """
    rows = [(p, [p // 3**i % 3 - 1 for i in range(LABELERS)], n) for p, n in sorted(counts.items())]
    total = sum(n for *_, n in rows)
    belief = LEAST_VOTES + PRIOR_SHARE * total
    share, right = 0.5, [(RIGHT, RIGHT)] * LABELERS
    post: dict[int, float] = {}
    for _ in range(rounds):
        for p, v, _ in rows:
            yes, no = math.log(share), math.log(1 - share)
            for (a, b), x in zip(right, v, strict=True):
                if x:
                    yes += math.log(a if x > 0 else 1 - a)
                    no += math.log(1 - b if x > 0 else b)
            post[p] = 1 / (1 + math.exp(min(max(no - yes, -30), 30)))
        share = min(max((sum(post[p] * n for p, _, n in rows) + 1) / (total + 2), 1e-6), 1 - 1e-6)
        right = []
        for i in range(LABELERS):
            tp, fn, tn, fp = (
                sum((post[p] if personal else 1 - post[p]) * n for p, v, n in rows if v[i] == vote) + (RIGHT if agrees else 1 - RIGHT) * belief
                for personal, vote, agrees in ((True, 1, True), (True, -1, False), (False, -1, True), (False, 1, False))
            )
            right.append((tp / (tp + fn), tn / (tn + fp)))
    return post, right, share


def _table(values: list[float]) -> Column:
    """An array of doubles from one literal."""
    return F.split(F.lit(" ".join(map(repr, map(float, values)))), " ").cast("array<double>")


def _score(s: Column, odds: list[float], weights: list[float]) -> Column:
    """Log odds that a span is personal."""
    table = _table(weights)
    return F.aggregate(s["features"], F.element_at(_table(odds), s["kind"] * 3**LABELERS + s["pattern"] + 1), lambda z, f: z + F.element_at(table, f + 1))


def train(spans: DataFrame) -> tuple[list[float], list[float]]:
    """Log odds by kind and vote pattern, and weights by feature, of the span classifier (spans: written)."""
    each = spans.select(F.explode("spans").alias("s"))
    counts: dict[int, dict[int, int]] = {}
    for r in each.groupBy("s.kind", "s.pattern").count().collect():  # at most 3**LABELERS for each kind
        counts.setdefault(r["kind"], {})[r["pattern"]] = r["count"]
    odds, weights = [0.0] * (len(KINDS) * 3**LABELERS), [0.0] * (len(KINDS) * FEATURES)
    for kind, own in counts.items():
        for p, q in expectation_maximisation(own)[0].items():
            odds[kind * 3**LABELERS + p] = math.log(q / (1 - q))
    for _ in range(REFINEMENTS if counts else 0):
        q = 1 / (1 + F.exp(-_score(F.col("s"), odds, weights)))
        # Decimals, so that the order of rows doesn't matter.
        soft = each.select(q.cast("decimal(20,9)").alias("q"), F.explode("s.features").alias("f")).groupBy("f").agg(F.sum("q").cast("double").alias("yes"), F.sum(1 - F.col("q")).cast("double").alias("no"))
        seen = {r["f"]: (r["yes"], r["no"]) for r in soft.collect()}  # at most FEATURES for each kind
        for kind in counts:
            ids = range(kind * FEATURES, (kind + 1) * FEATURES)
            yes, no = (sum(seen.get(f, (0, 0))[side] for f in ids) + SMOOTHING * FEATURES for side in (0, 1))
            for f in ids:
                a, b = seen.get(f, (0, 0))
                weights[f] = math.log((a + SMOOTHING) / yes) - math.log((b + SMOOTHING) / no)
    return odds, weights


def detect(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`doc` (the columns `carry` of docs, all by default) and `spans`: array of (kind, start, end), by kind, then start."""
    found = cut(vote_patterns(candidates(docs, text, carry)), "private-spans")
    odds, weights = train(found)
    names = F.array(*(F.lit(k) for k in KINDS))
    stay = F.filter("spans", lambda s: (s["kind"] < len(BASE)) | (_score(s, odds, weights) >= LEAST_ODDS))
    kept = F.transform(stay, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc", kept.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of the documents that detect() packed, each span of the text replaced by its kind in brackets.

    Overlapping spans become one, named after the first.  Null texts stay null.
    """
    t = F.col("doc")[text]
    # By start, the longest first.
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    ordered = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["less"]).alias("end"), s["kind"].alias("kind")))

    def join(done, s):
        last = F.element_at(done, -1)
        longer = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind")))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"]), longer).otherwise(F.array_append(done, s))

    merged = F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int,kind:string>>"), join)
    rows = found.select("doc", F.when(F.size("spans") > 1, merged).otherwise(ordered).alias("spans"))
    m = F.col("spans")
    parts = F.transform(m, lambda s, i: F.concat(t.substr(F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = t.substr(F.element_at(m, -1)["end"] + 1, F.length(t))
    done = F.when(F.size(m) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(t)
    return rows.select(*(done.alias(c) if c == text else F.col("doc")[c].alias(c) for c in columns))
