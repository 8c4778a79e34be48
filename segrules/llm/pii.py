"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from the exact patterns and from looser ones: spelled addresses, long addresses,
phone numbers without a country, and runs that may be secrets (passwords, tokens, access keys).
Five labelers (pattern, check, gazetteer, context, shape) vote on every candidate; expectation
maximisation over the counts of vote patterns estimates how reliable each is for
each kind.  A logistic span classifier is trained on the resulting
probabilities, from the votes and from what no labeler sees: neighbours, length and the mix of characters.
Spans of the exact patterns always stay; the classifier adds loose ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segrules.llm.common import pick
from segrules.session import cut_lineage

# Kinds with exact patterns in the order of the result, then those with loose forms only.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# The exact patterns.  Possessive and anchored at the start of a run, they find what the plain
# patterns find leftmost and non-overlapping, in time linear in the text.
EXACT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Looser forms that only the classifier can admit.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[({]dot[\])}] ?)[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "phone": r"(?<![0-9A-Za-z+.,(/-])(?<![0-9+)] )(?:\([0-9]{3}\) |[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.,/-][0-9])",
    # A run of letters and digits, or an access key by its form.
    "secret": r"(?<![\p{L}0-9_+/-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,128}+={0,2}+)(?![\p{L}0-9_+/=-])",
}
# What a text must hold for a pattern to be worth a search.
NEEDS = {("email", True): "@", ("phone", True): "+"}

# Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info biz io me app dev eu uk de fr es it nl be at ch se no dk fi pl pt ie ru cn jp kr in br mx ca us au nz za"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
# Words near a span that speak for its kind, and against any.
CONTEXT = {
    "email": r"e-?mail|mail|contact|write|reply|adresse|correo|courriel",
    "ip": r"\bip\b|address|host|server|login|logged|client|adresse",
    "card": r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|cell|fax|whatsapp|sms|telefon|t[ée]l[ée]phone|tel[ée]fono",
    "secret": r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|bearer|credentials?)[\"']?\s?[:=]?\s?[\"']?$",
}
AGAINST = r"version|release|section|chapter|figure|isbn|issn|sku|serial|build|revision|invoice|commit|checksum|sha-?[0-9]|md5|uuid|https?:"
# How keys of well-known issuers begin, and the lengths of hexadecimal ones.
KEY_FORMS = r"^(?:AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[abp]-|AIza)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"

LABELERS = ("by_pattern", "by_check", "by_gazetteer", "by_context", "by_shape")
# Neighbours, length and characters of a span, each in three steps.
TRAITS = ("left_step", "right_step", "size_step", "mix_step")
# What is held of a labeler before any count: how often it says -1, 0, 1 of real spans, and of others.
SAID_OF_REAL, SAID_OF_OTHERS = (0.5, 1.0, 2.0), (2.0, 1.0, 0.5)


def _matches(kind: str, exact: bool) -> Column:
    """Array of (kind, exact, i, gap, found, before, after): gap is the number of code points since the last match."""
    pattern = (EXACT if exact else LOOSE)[kind]
    text = F.col("text")
    needed = NEEDS.get((kind, exact))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    # The lambda reads ``found`` and ``pieces`` once, as arguments of one zip.
    spans = F.when(
        F.regexp_like(text, F.lit(pattern)),
        F.transform(
            F.arrays_zip(
                found.alias("found"), F.slice(pieces, 1, F.size(found)).alias("piece"), F.slice(pieces, 2, F.size(found)).alias("next")
            ),
            lambda s, i: F.struct(
                F.lit(ALL_KINDS.index(kind)).alias("kind"),
                F.lit(exact).alias("exact"),
                i.alias("i"),
                F.char_length(s["piece"]).alias("gap"),
                s["found"].alias("found"),
                F.lower(F.right(s["piece"], F.lit(40))).alias("before"),
                F.left(s["next"], F.lit(1)).alias("after"),
            ),
        ),
    )
    if needed:
        spans = F.when(F.contains(text, F.lit(needed)), spans)
    return F.coalesce(spans, F.array().cast("array<struct<kind:int,exact:boolean,i:int,gap:int,found:string,before:string,after:string>>"))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    weighed = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _per_kind(kind: Column, **by: Column) -> Column:
    out = F.lit(None)
    for name, value in by.items():
        out = F.when(kind == ALL_KINDS.index(name), value).otherwise(out)
    return out


def _valid() -> Column:
    """Whether an exact match meets its kind's condition."""
    digits = _digits(F.col("found"))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return _per_kind(
        F.col("kind"),
        email=F.lit(True),
        ip=F.regexp_like("found", F.lit(rf"^{part}(?:\.{part}){{3}}$")),
        card=luhn(digits),
        phone=F.char_length(digits).between(8, 15),
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes() -> dict[str, Column]:
    found, kind, exact = F.col("found"), F.col("kind"), F.col("exact")
    digits = _digits(found)
    top = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS.split())
    octet = F.regexp_extract(found, r"^0*([0-9]{1,3})", 1).try_cast("int")
    issuer = F.regexp_like(digits, F.lit(r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6[0245])"))
    codes = F.regexp_like(digits, F.lit("^(?:" + "|".join(CALLING_CODES.split()) + ")"))
    area = F.regexp_like(digits, F.lit("^[2-9][0-9]{2}[2-9]"))
    issued, wordy = F.regexp_like(found, F.lit(KEY_FORMS)), F.regexp_like(found, F.lit("[a-z]{6}"))
    gazetteer = _per_kind(
        kind,
        email=_vote(top, ~top),
        ip=_vote(octet.between(1, 223), (octet == 0) | (octet > 223)),
        card=_vote(issuer, ~issuer),
        phone=F.when(exact, _vote(codes, ~codes)).otherwise(_vote(area, ~area)),
        secret=_vote(issued, wordy),
    )
    near = _per_kind(kind, **{k: F.regexp_like("before", F.lit(v)) for k, v in CONTEXT.items()})
    canonical = F.regexp_like(found, F.lit(r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$|:"))
    grouped = F.regexp_like(found, F.lit(r"^[0-9]+$|^[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -]?[0-9]{1,3})?$"))
    balanced = F.regexp_count(found, F.lit(r"\(")) == F.regexp_count(found, F.lit(r"\)"))
    turns = F.regexp_count(found, F.lit("[A-Za-z][0-9]|[0-9](?=[A-Za-z])"))
    shape = _per_kind(
        kind,
        email=_vote(~F.contains(found, F.lit("..")) & (F.char_length(found) <= 254), F.contains(found, F.lit(".."))),
        ip=_vote(canonical, ~canonical),
        card=_vote(grouped, F.lit(False)),
        phone=_vote(balanced & F.char_length(digits).between(10, 13), ~balanced),
        secret=_vote(turns >= 4, turns < 2),
    )
    return {
        "by_pattern": _vote(exact, F.lit(False)),
        "by_check": F.when(~exact | (kind == ALL_KINDS.index("email")), 0).when(F.col("valid"), 1).otherwise(-1),
        "by_gazetteer": F.coalesce(gazetteer, F.lit(0)),
        "by_context": _vote(near, F.regexp_like("before", F.lit(AGAINST))),
        "by_shape": F.coalesce(shape, F.lit(0)),
    }


def _traits() -> dict[str, Column]:
    found, size = F.col("found"), F.char_length("found")

    def beside(c: Column) -> Column:
        return F.when((c == "") | F.regexp_like(c, F.lit(r"\s")), 0).when(F.regexp_like(c, F.lit(r"[\"'`=:;,()\[\]{}<>]")), 1).otherwise(2)

    letters, digits = F.regexp_like(found, F.lit("[A-Za-z]")), F.regexp_like(found, F.lit("[0-9]"))
    return {
        "left_step": beside(F.right("before", F.lit(1))),
        "right_step": beside(F.col("after")),
        "size_step": F.when(size < 12, 0).when(size < 24, 1).otherwise(2),
        "mix_step": F.when(~letters, 0).when(digits, 1).otherwise(2),
    }


def estimate_reliabilities(kind: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that each vote pattern marks a real span, by expectation maximisation.

    ``votes`` has a row of -1, 0, 1 per pattern.  For each kind the labelers are
    taken as independent given the truth; what they say of real and of
    other spans is re-estimated until the rounds are used up, starting from the majority and leaning on
    :data:`SAID_OF_REAL` and :data:`SAID_OF_OTHERS`, which a few dozen candidates outweigh.
    """
    truth = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.1, 0.9)
    for k in np.unique(kind):
        own = kind == k
        v, n, p = votes[own], counts[own], truth[own]
        for _ in range(rounds):
            real, others = n @ p, n @ (1 - p)
            log_odds = np.full(len(p), math.log((real + 1) / (others + 1)))
            for j in range(v.shape[1]):
                for value, a, b in zip((-1, 0, 1), SAID_OF_REAL, SAID_OF_OTHERS):
                    said = v[:, j] == value
                    yes = (n[said] @ p[said] + a) / (real + sum(SAID_OF_REAL))
                    no = (n[said] @ (1 - p[said]) + b) / (others + sum(SAID_OF_OTHERS))
                    log_odds += said * math.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        truth[own] = p
    return truth


def train_span_classifier(features: np.ndarray, truth: np.ndarray, counts: np.ndarray, steps: int = 400, l2: float = 1.0) -> np.ndarray:
    """Weights (the bias last) of a logistic model on feature patterns with soft labels, by Newton's method's diagonal."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (truth - p)) - l2 * w
        curvature = (x * x).T @ (counts * p * (1 - p)) + l2
        w += 0.3 * gradient / curvature
    return w


# The classifier's inputs: each labeler's vote for and against, the kind, and the traits.
def _feature_columns() -> list[Column]:
    return [
        *[(F.col(name) == value).cast("double") for name in LABELERS for value in (-1, 1)],
        *[(F.col("kind") == k).cast("double") for k in range(len(ALL_KINDS))],
        *[(F.col(name) == s).cast("double") for name in TRAITS for s in range(3)],
    ]


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has row_id and doc_id of every row; spans the candidates with place, votes and features."""
    rows = pick(docs, "doc_id", "text")
    found = F.concat(*[_matches(k, True) for k in KINDS], *[_matches(k, False) for k in LOOSE])
    scanned = cut_lineage(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", found.alias("found")), "pii_scan")
    each = scanned.where(F.size("found") > 0).select("row_id", F.explode("found").alias("s")).select("row_id", "s.*")
    in_order = Window.partitionBy("row_id", "kind", "exact").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("found")
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(in_order)).withColumn("start", F.col("end") - size)
    voted = placed.withColumn("valid", F.when(F.col("exact"), _valid()).otherwise(False)).withColumns(_votes())
    kept = voted.withColumns(_traits()).select("row_id", "kind", "exact", "start", "end", "valid", *LABELERS, *TRAITS)
    return scanned.select("row_id", "doc_id"), cut_lineage(kept, "pii_spans")


def _classifier(spans: DataFrame) -> Column:
    """Column with the probability of a span, from weights fitted to the counts of feature patterns.

    There are at most 5 kinds x 3^5 votes x 3^4 traits patterns (98,415), so what comes to the driver is bounded.
    """
    keys = ["kind", *LABELERS, *TRAITS]
    seen = spans.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.first(c) for c in _feature_columns()]).alias("x")).collect()
    if not seen:
        return F.lit(0.0)
    seen = sorted(seen, key=lambda r: [r[k] for k in keys])
    counts = np.array([float(r["n"]) for r in seen])
    votes = np.array([[r[name] for name in LABELERS] for r in seen])
    # Patterns that differ in traits alone have the same votes: their counts add up in the estimate.
    truth = estimate_reliabilities(np.array([r["kind"] for r in seen]), votes, counts)
    weights = train_span_classifier(np.array([r["x"] for r in seen]), truth, counts)
    z = F.lit(float(weights[-1]))
    for w, c in zip(weights[:-1], _feature_columns()):
        z = z + float(w) * c
    return 1 / (1 + F.exp(-z))


def find_personal_data(docs: DataFrame, admit: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of
    (kind, start, end, base, score) by kind as in :data:`ALL_KINDS`, then start.

    Places are code points, the end exclusive.  ``base`` spans are the exact patterns'
    matches that meet their kind's condition, leftmost and non-overlapping per kind;
    other exact matches are dropped without another try.  The rest are loose
    matches that the classifier gives at least ``admit`` and that overlap no exact match;
    those of kind ``secret`` are all of this sort.

    Edge cases: a null or empty text has no spans; ids may be null or repeated, each row is
    judged by itself; other columns are ignored; an empty table gives an empty result.

    Scale: one scan of the texts, which are never shuffled; only candidates are.
    The driver sees counts of vote patterns, a bounded number.
    """
    texts, spans = candidates(docs)
    score = _classifier(spans)
    scored = spans.withColumn("score", score)
    by_start = Window.partitionBy("row_id").orderBy("start", "end")
    seen = by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    clear = scored.withColumn("reached", F.max(F.when(F.col("exact"), F.col("end"))).over(seen)).withColumn(
        "next", F.min(F.when(F.col("exact"), F.col("start"))).over(ahead)
    )
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    admitted = clear.where(F.col("valid") | (~F.col("exact") & (F.col("score") >= admit) & free))
    gathered = admitted.groupBy("row_id").agg(
        F.sort_array(
            F.collect_list(F.struct("kind", "start", "end", F.col("valid").alias("base"), "score"))
        ).alias("spans")
    )
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean,score:double>>")
    return texts.join(gathered, "row_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
