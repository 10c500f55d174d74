"""Personal data by weak supervision, with DataFrame functions only.

Patterns give base spans, which always stay, and further candidates: addresses spelled out, numbers without a plus sign, names of people.
Labelers of three sorts vote on every candidate: patterns (strict form, checksum), gazetteers (endings of domains, country codes,
first names, words that are no names) and context (cue words, words that say otherwise, units, what it is glued to). Only
(kind, votes, shape) and their counts are needed to learn: expectation-maximisation estimates how reliable each labeler is for each
kind, and a logistic span classifier is trained on the posteriors; both are sums over that small table. The classifier decides
which further candidates become spans.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Patterns of base spans. Quantifiers keep what they have taken wherever that can't change a match, so that each text is read in linear
#: time; an address may begin inside a run of its letters only where another has just ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sra|Sr|Don|Doña"
#: Patterns of further candidates.
FURTHER = {
    "mail": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:[(\[{<]\x20?at\x20?[)\]}>]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:\x20?(?:[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20)[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "number": r"(?<![\p{L}\p{N}_.+@-])\(?+[0-9]++(?:[).\x20/-]{1,2}+\(?+[0-9]++)*+",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES})\.?+\x20)?+\p{{Lu}}\p{{Ll}}++(?:[\x20-]\p{{Lu}}\p{{Ll}}++)*+",
}
KINDS = [*BASE, *FURTHER]
#: What a text must have for a pattern to be tried.
_NEEDS = {"email": "@", "phone": "+", "mail": r"(?i)[(\[{<]\x20?at\x20?[)\]}>]|\x20dot\x20", "ip": "[0-9]", "card": "[0-9]", "number": "[0-9]"}
LEFT, RIGHT = 40, 12
#: The longest candidates that are judged by their form.
LONGEST = 254

#: Gazetteers.
ENDINGS = "com org net edu gov mil int info biz io co me dev app ai eu de fr es it uk us ca au ch at be nl se no dk fi pl pt cz ie jp cn in br mx ru".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split()
FIRST_NAMES = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen
Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda
Brian Melissa George Deborah Timothy Stephanie Edward Rebecca Jason Laura Jeffrey Helen Ryan Sharon Jacob Cynthia Gary Kathleen Nicholas Amy Eric Angela Jonathan Shirley
Hans Peter Klaus Jürgen Wolfgang Andreas Stefan Ursula Monika Petra Sabine Renate Heike Anna Lukas Felix Jonas Lena Lea
Pierre Jean Michel Philippe Alain Nicolas Marie Nathalie Isabelle Sylvie Catherine Camille Chloé Léa Louis Jules
José Antonio Manuel Francisco Juan Carlos Javier Miguel Luis Carmen Ana Isabel Dolores Pilar Teresa Lucía Sofía Elena Marta Pablo""".split()
NO_NAMES = """January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday
Street Avenue Road University College Institute Museum Company Corporation Bank Church School Park River Lake Island Mountain City County State States Kingdom Republic
License Licence Public General Version Apache Creative Commons Street North South East West New Old Saint San Los Las The This That Louvre Foundation Award Prize""".split()
CUES = {
    "email": r"mail|contact|write|reach|send|correo|courriel|schreib|reply", "ip": r"\bip\b|address|host|server|client|login|logged|from|adresse", "card": r"card|visa|master|credit|debit|pay|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|fax|mobile|\bcell|ring|anruf|handy|appel|llam|whatsapp", "mail": r"mail|contact|write|reach|send|correo|courriel|schreib|reply",
    "number": r"phone|\btel|call|fax|mobile|\bcell|ring|anruf|handy|appel|llam|whatsapp|\bssn\b|social security|passport|card|account|iban|konto|tax id",
    "name": r"name|dear|signed|sincerely|regards|author|born|patient|employee|customer|contact|by $",
}
COUNTER_CUES = {
    "email": r"example|regex|pattern", "ip": r"version|release|build|section|chapter|firmware", "card": r"isbn|order|invoice|serial|tracking|part|token|hash|\bsku\b", "phone": r"isbn|order|invoice|diff|delta|offset",
    "mail": r"regex|pattern", "number": r"isbn|issn|order|invoice|serial|tracking|version|build|part|page|token|hash|\bsku\b|price|total|\bid\b|number of|lines|population|pi =",
    "name": r"located|city|company|film|song|university|called the|street",
}
UNITS = r"^\s?(?:%|kg|km|cm|mm|mb|gb|tb|ms|sec|min|hours|days|years|people|usd|eur|dollars|euros|px|pages|copies|street|avenue|university|inc\b|ltd\b|gmbh)"

#: Labelers in the order of votes.
LABELERS = ["form", "checksum", "known", "counter", "cue", "counter_cue", "unit", "glued"]
SHAPES = (8, 12, 16, 24)
#: What is taken of a kind before anything is learned, how the labelers are taken to vote (right, wrong), and how much that weighs: a share of the
#: kind's candidates and a number.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.9, "mail": 0.5, "number": 0.3, "name": 0.4}
RIGHT_VOTES, WRONG_VOTES, PRIOR_SHARE, PRIOR_ROWS = 0.4, 0.05, 0.2, 20.0


# --- spans --------------------------------------------------------------------------------------------------------------


def running(values: Column, join) -> Column:
    """What ``join`` makes of each value and all before it, in as many doublings as the logarithm of their number."""
    n = F.size(values)

    def double(acc: Column, k: Column) -> Column:
        shift = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(acc))
        back = F.concat(F.array_repeat(F.lit(None).cast("int"), shift), F.slice(acc, F.lit(1), F.size(acc) - shift))
        return F.zip_with(acc, back, join)

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")), values, double)


_plus = lambda a, b: a + F.coalesce(b, F.lit(0))


def _found(hits: Column, gaps: Column) -> Column:
    """Places of a pattern's matches, from the matches and what is between them: (start, end, hit, left, right)."""
    n = F.size(hits)
    before = F.concat(F.array(F.lit(0)), F.transform(F.slice(hits, F.lit(1), n - 1), F.length))
    starts = running(F.zip_with(F.transform(F.slice(gaps, F.lit(1), n), F.length), before, lambda a, b: a + b), _plus)
    around = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda a, b: F.struct(F.right(a, F.lit(LEFT)).alias("left"), F.left(b, F.lit(RIGHT)).alias("right")))
    placed = F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("hit")))
    return F.zip_with(placed, around, lambda p, a: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["hit"].alias("hit"), a["left"].alias("left"), a["right"].alias("right")))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _part_fits(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) <= 3) & (F.coalesce(F.substring(short, 1, 3).try_cast("int"), F.lit(0)) <= 255)


def _holds(kind: str, hit: Column) -> Column:
    """What else a match must be."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _part_fits)
    if kind == "card":
        plain = F.translate(hit, " -", "")
        return F.length(plain).between(14, 19) & F.call_function("luhn_check", plain)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    if kind == "mail":
        return F.rlike(hit, F.lit(r"(?i)[(\[{<]\x20?at|\x20dot\x20|[(\[{<]\x20?dot"))
    if kind == "number":
        return F.length(_digits(hit)).between(7, 19)
    if kind == "name":
        words = F.split(hit, "[ -]")
        return F.rlike(hit, F.lit(rf"^(?:{_TITLES})\.?\x20")) | ((F.size(words) > 1) & words[0].isin(FIRST_NAMES))
    return F.lit(True)


# --- labelers -----------------------------------------------------------------------------------------------------------


def _vote(yes: Column | None = None, no: Column | None = None) -> Column:
    out = F.lit(0)
    if no is not None:
        out = F.when(no, -1).otherwise(out)
    if yes is not None:
        out = F.when(yes, 1).otherwise(out)
    return out


def _votes(kind: str, x: Column) -> list[Column]:
    """One of 1 (personal), -1 (not) and 0 (no vote) a labeler."""
    hit, left, right = F.substring(x["hit"], 1, LONGEST), x["left"], x["right"]
    like = lambda t, p: F.rlike(t, F.lit(p))
    digits = F.substring(_digits(hit), 1, 20)
    ending = F.lower(F.element_at(F.split(hit, "[^A-Za-z0-9]+"), -1))
    form = {
        "email": _vote(like(hit, r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}$"), like(hit, r"\.\.|^[._-]|\.@|@-|\.[0-9]+$")),
        "ip": _vote(~like(hit, r"(?:^|\.)0[0-9]|^0\."), like(hit, r"(?:^|\.)0[0-9]|^0\.")),
        "card": _vote(like(hit, r"^(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"), like(hit, r"(?:^| )[0-9](?: |$)")),
        "phone": _vote(like(hit, r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,5}){1,4}$"), like(hit, r"[ ().-]{3}")),
        "mail": _vote(like(hit, r"(?i)[(\[{<]\x20?at"), None),
        "number": _vote(like(hit, r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[ /-][0-9 /-]{5,})$"), like(hit, r"^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2})|[0-9]\.[0-9]")),
        "name": _vote(like(hit, rf"^(?:{_TITLES})\.?\x20"), F.size(F.split(hit, "[ -]")) > 4),
    }[kind]
    checked = F.call_function("luhn_check", digits)
    checksum = {"card": _vote(checked), "number": F.when(F.length(digits) >= 13, _vote(checked, ~checked)).otherwise(0)}.get(kind, F.lit(0))
    code = F.regexp_extract(hit, r"^\+([0-9]{1,3})", 1)
    first = F.regexp_replace(hit, rf"^(?:{_TITLES})\.?\x20", "")
    known = {
        "email": _vote(ending.isin(ENDINGS), ~ending.isin(ENDINGS)), "mail": _vote(ending.isin(ENDINGS), ~ending.isin(ENDINGS)),
        "phone": _vote(code.isin(COUNTRY_CODES) | F.substring(code, 1, 2).isin(COUNTRY_CODES) | F.substring(code, 1, 1).isin(COUNTRY_CODES), code.startswith("0")),
        "name": _vote(F.split(first, "[ -]")[0].isin(FIRST_NAMES) & (F.size(F.split(first, "[ -]")) <= 3)),
    }.get(kind, F.lit(0))
    counter = {
        "ip": _vote(None, like(hit, r"^(?:0|127|255)\.")), "number": _vote(None, like(digits, r"^([0-9])\1+$|^0?123456789")), "card": _vote(None, like(digits, r"^([0-9])\1+$")),
        "name": _vote(None, F.arrays_overlap(F.split(first, "[ -]"), F.array(*(F.lit(w) for w in sorted(set(NO_NAMES)))))), "email": _vote(None, like(hit, r"(?i)^(?:no-?reply|postmaster|abuse)@")),
    }.get(kind, F.lit(0))
    glue = like(left, r"[\p{L}\p{N}_=/#&$€£-]$") | like(right, r"^[\p{L}\p{N}_=/#&$€£-]")
    return [v.cast("tinyint") for v in (form, checksum, known, counter, _vote(like(F.lower(left), CUES[kind])), _vote(None, like(F.lower(left), COUNTER_CUES[kind])), _vote(None, like(F.lower(right), UNITS)), _vote(None, glue))]


def _shape(hit: Column) -> Column:
    return sum((F.when(F.length(hit) >= s, 1).otherwise(0) for s in SHAPES), F.lit(0)).cast("tinyint")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with one row a row: spans (start, place of kind, end, kind, base, votes, shape) in order, those of further kinds
    only where they touch no base span."""
    text = "_text"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias(text))
    patterns = BASE | FURTHER
    none = F.array().cast("array<string>")
    may = {k: F.contains(text, F.lit(n)) if len(n) == 1 else F.rlike(text, F.lit(n)) for k, n in _NEEDS.items()}
    hits = {k: F.regexp_extract_all(text, F.lit(p), 0) for k, p in patterns.items()}
    own = own.withColumns({f"_h_{k}": F.when(may[k], h).otherwise(none) if k in may else h for k, h in hits.items()})
    own = own.withColumns({f"_g_{k}": F.when(F.size(f"_h_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()}).drop(text)

    def spans(kind: str) -> Column:
        held = F.filter(_found(F.col(f"_h_{kind}"), F.col(f"_g_{kind}")), lambda x: F.coalesce(_holds(kind, x["hit"]), F.lit(False)))
        item = lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(kind in BASE).alias("base"), F.array(*_votes(kind, x)).alias("votes"), _shape(x["hit"]).alias("shape"))
        empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,base:boolean,votes:array<tinyint>,shape:tinyint>>")
        return F.when(F.size(f"_h_{kind}") > 0, F.transform(held, item)).otherwise(empty)

    own = own.select("doc_id", F.array_sort(F.concat(*(spans(k) for k in BASE))).alias("base"), F.concat(*(spans(k) for k in FURTHER)).alias("further"))
    every = own.select("doc_id", "base", F.when(F.size("further") > 0, F.array_sort(F.concat("base", "further"))).alias("every"))
    furthest = running(F.transform("every", lambda x: F.when(x["base"], x["end"])), lambda a, b: F.greatest(a, b))
    nearest = F.reverse(running(F.reverse(F.transform("every", lambda x: F.when(x["base"], x["start"]))), lambda a, b: F.least(a, b)))
    touched = F.zip_with(furthest, nearest, lambda a, b: F.struct(a.alias("ends"), b.alias("begins")))
    marked = F.zip_with("every", touched, lambda x, t: F.struct(x.alias("x"), (x["base"] | (F.coalesce(t["ends"] <= x["start"], F.lit(True)) & F.coalesce(t["begins"] >= x["end"], F.lit(True)))).alias("free")))
    return every.select("doc_id", F.when(F.col("every").isNull(), F.col("base")).otherwise(F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["x"])).alias("spans"))


# --- learning -----------------------------------------------------------------------------------------------------------


def patterns_of(found: DataFrame) -> DataFrame:
    """(kind, votes..., shape, n): how often the labelers vote so; at most kinds x shapes x 3 ** labelers rows whatever the corpus has."""
    each = found.select(F.explode("spans").alias("s")).select("s.kind", *(F.col("s.votes")[j].alias(v) for j, v in enumerate(LABELERS)), "s.shape")
    return each.groupBy("kind", *LABELERS, "shape").agg(F.count("*").alias("n"))


#: How a labeler that has both votes is taken to vote of personal data; of other data it is the other way round.
def _assumed(y: int, vote: int) -> float:
    right = 1 if y else -1
    return RIGHT_VOTES if vote == right else WRONG_VOTES if vote == -right else 1 - RIGHT_VOTES - WRONG_VOTES


def reliabilities(table: DataFrame, rounds: int = 20, least_change: float = 2e-3) -> dict[str, dict]:
    """By kind: the share that is personal, and for each labeler how often it votes so of personal and of other data; by
    expectation-maximisation. A round is one grouped sum over the table of patterns: a row a kind, labeler and vote."""
    counts = {r["kind"]: r["n"] for r in table.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    weight = {k: PRIOR_SHARE * n + PRIOR_ROWS for k, n in counts.items()}
    now = {k: {"share": PRIOR[k], "votes": [[[_assumed(y, v) for v in (-1, 0, 1)] for y in (0, 1)] for _ in LABELERS]} for k in counts}
    votes = F.array(*(F.col(name).cast("int") for name in LABELERS))
    each = table.select("*", F.posexplode(votes).alias("labeler", "vote")) if counts else table
    for _ in range(rounds if counts else 0):
        sums = each.withColumn("_p", posterior(now)).groupBy("kind", "labeler", "vote").agg(F.sum(F.col("n") * F.col("_p")).alias("yes"), F.sum("n").alias("all")).collect()
        change = 0.0
        for k, n in counts.items():
            seen, w = np.zeros((len(LABELERS), 2, 3)), weight[k]
            for r in sums:
                if r["kind"] == k:
                    seen[r["labeler"], :, r["vote"] + 1] = r["all"] - r["yes"], r["yes"]
            mass = seen[0].sum(1)
            share = (mass[1] + w * PRIOR[k]) / (n + w)
            told = (seen + w * np.array([[_assumed(y, v) for v in (-1, 0, 1)] for y in (0, 1)])) / (mass[:, None] + w)
            change = max(change, abs(share - now[k]["share"]), float(np.abs(told - np.array(now[k]["votes"])).max()))
            now[k] = {"share": float(share), "votes": told.tolist()}
        if change < least_change:
            break
    return now


def _constants(values: list[float]) -> str:
    return f"array({', '.join(f'{float(x)!r}D' for x in values)})"


def posterior(learned: dict[str, dict]) -> Column:
    """The probability that a pattern's rows are personal, from what the labelers are like: a look-up in one constant map, so that
    all rounds run the same compiled code."""
    entries = []
    for k, own in learned.items():
        odds = [math.log(own["share"] / (1 - own["share"]))] + [math.log(own["votes"][j][1][i] / own["votes"][j][0][i]) for j in range(len(LABELERS)) for i in range(3)]
        entries.append(f"'{k}', {_constants(odds)}")
    of = F.element_at(F.expr(f"map({', '.join(entries)})"), F.col("kind"))
    chosen = F.array(F.lit(0), *(F.col(name).cast("int") + 3 * j + 2 for j, name in enumerate(LABELERS)))
    return 1 / (1 + F.exp(-F.aggregate(F.transform(chosen, lambda i: of[i]), F.lit(0.0), lambda a, b: a + b)))


def _features(kind: Column, votes: list[Column], shape: Column) -> Column:
    """The numbers of the features that hold: the kind, each labeler's votes for and against, and the steps in length."""
    m, k = len(LABELERS), len(KINDS)
    place = F.element_at(F.create_map(*(F.lit(x) for i, name in enumerate(KINDS) for x in (name, i))), kind)
    said = [F.when(v == 1, k + j).when(v == -1, k + m + j) for j, v in enumerate(votes)]
    return F.array_compact(F.array(place, *said, *(F.when(shape > s, k + 2 * m + s) for s in range(len(SHAPES)))))


FEATURES = len(KINDS) + 2 * len(LABELERS) + len(SHAPES)


def _weighed(features: Column, weights: list[float]) -> Column:
    w = F.expr(_constants(weights))
    return F.aggregate(F.transform(features, lambda i: w[i]), F.lit(0.0), lambda a, b: a + b)


def train(table: DataFrame, learned: dict[str, dict], steps: int = 12, ridge: float = 1.0) -> list[float]:
    """Weights of the logistic span classifier on the posteriors, by Newton steps: a step is one grouped sum over pairs of features."""
    w = np.zeros(FEATURES)
    if not learned:
        return w.tolist()
    rows = saved(table.select("n", posterior(learned).alias("p"), _features(F.col("kind"), [F.col(v) for v in LABELERS], F.col("shape")).alias("x")), "personal-features")
    for _ in range(steps):
        own = rows.withColumn("q", 1 / (1 + F.exp(-_weighed(F.col("x"), w.tolist()))))
        pairs = own.select("n", "p", "q", "x", F.explode("x").alias("i")).select("n", "p", "q", "i", F.explode("x").alias("j"))
        sums = pairs.groupBy("i", "j").agg(F.sum(F.col("n") * F.col("q") * (1 - F.col("q"))).alias("h"), F.sum(F.col("n") * (F.col("p") - F.col("q"))).alias("g")).collect()
        hess, slope = ridge * np.eye(FEATURES), -ridge * w
        for r in sums:
            hess[r["i"], r["j"]] += r["h"]
            if r["i"] == r["j"]:
                slope[r["i"]] += r["g"]
        step = np.linalg.solve(hess, slope)
        w = w + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-5:
            break
    return w.tolist()


def is_personal(weights: list[float], span: Column, threshold: float = 0.5) -> Column:
    return _weighed(_features(span["kind"], [span["votes"][j] for j in range(len(LABELERS))], span["shape"]), weights) >= math.log(threshold / (1 - threshold))


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): one row a row of ``docs`` (doc_id, text; other columns are ignored).

    Spans are kind:start:end in code points, the end exclusive, ordered by start and then kind; kinds of added spans are mail (an address spelled out),
    number (a phone, card or identity number without a plus sign) and name. The corpus itself teaches how far labelers are to be
    believed, so that a span is added by what is usual there. A null text is an empty one; a text without spans has an empty
    string and the digest of one. Repeated rows and null doc_ids each give a row, an empty table none. Texts are read whole, in time
    linear in their length but for a logarithm of their number of matches.
    """
    found = saved(candidates(docs), "personal-candidates")
    table = saved(patterns_of(found), "personal-patterns")
    weights = train(table, reliabilities(table))
    base = F.filter("spans", lambda x: x["base"])
    kept = F.filter("spans", lambda x: x["base"] | is_personal(weights, x, threshold))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = [F.size(F.filter("spans", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023  called at once
    return found.select("doc_id", *number, F.sha2(text(base), 256).alias("base_sha256"), text(kept).alias("spans"), (F.size(kept) - F.size(base)).cast("long").alias("n_added"))
