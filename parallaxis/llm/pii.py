"""Personal data and credentials by weak supervision, in DataFrame functions throughout.

Base spans are those of four patterns with their checks (email, ip, card, phone). Candidates of further kinds are
credentials (long tokens with a digit, and what is assigned to a word that names credentials), bank accounts, national
insurance and passport numbers, dates of birth, names and street addresses, in four languages. Four labelers vote on each,
or abstain: known formats and check digits (regex), words before or in it (gazetteer), assignment and prose around it
(context), and the mix of its characters (shape). The numbers of each kind's vote patterns are counted over all documents,
expectation-maximisation estimates the labelers' reliabilities from these at most 3**4 counts, and a logistic span
classifier per kind is trained on the resulting probabilities over cells of span features, of which there is a fixed
number. Its weights go back into the plan as literals. Of added spans that overlap the more special kind stays.

Rows: null text counts as empty and has no spans; a null doc_id is kept; repeated rows stay; without candidates no
classifier is trained and the base spans stand alone. Empty tables give no rows; other columns take no part.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import columns_or_null, materialize

KINDS = ("email", "ip", "card", "phone", "secret", "name", "address", "birth", "passport", "national", "iban")
# Possessive and anchored forms of the base patterns: the same matches, without retries inside a run of characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NAMES = r"password|passwd|pwd|passphrase|secret|token|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|credential|bearer|auth"
#: Tokens that may be credentials: what a word that names credentials and an assignment mark stand before, if 6 or more
#: characters long, and other runs of 16 or more characters with a digit.
GIVEN = rf"(?<=[=:][\x20\"']{{0,2}})(?<=(?i:{NAMES})[\"']?\x20?[=:]\x20?[\"']?)[^\x20\x09-\x0D\"',;]{{6,}}+"
LONG = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+"
TOKEN = f"{GIVEN}|{LONG}"
#: Key formats, and the words that name credentials.
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|(?:ghp|gho|ghs)_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{16,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
GAZETTEER = rf"(?i)(?:{NAMES})[\x20:=\"']*$"
ASSIGNED = r"[=:]\x20?[\"']?$"
PROSE = r"[A-Za-z,.;]\x20$"
BEFORE = 24
LABELERS = ("by_format", "by_word", "by_context", "by_shape")
#: Share of wrong votes from which each labeler's estimation starts: rather right than wrong, a known format
#: nearly always, the mix of characters least.
STARTS_WRONG = (0.01, 0.1, 0.2, 0.3)
FEATURES = (*LABELERS, "size", "share", "upper", "lower")


#: Words of the four languages that say what follows or precedes.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Professor|Sir|Madam|Herr|Frau|Señor|Señora|Doña|Monsieur|Madame|Mademoiselle|Mme"
CALLED = "[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Mm]e llamo|[Mm]i nombre es|[Jj]e m'appelle|[Mm]on nom est|[Nn]ame:|[Nn]ombre:|[Nn]om:"
FIRST_NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Thomas|Sarah|Peter|Anna|Hans|Klaus|Jürgen|Wolfgang|Heinz|Ursula|Monika|Petra|Sabine|Stefan|Andreas|"
    "José|Carmen|Antonio|María|Manuel|Josefa|Francisco|Isabel|Carlos|Lucía|Pedro|Jean|Marie|Pierre|Nathalie|Michel|Isabelle|Philippe|Sylvie|Alain|Catherine|Jacques|Claire"
)
BORN = "born(?: on)?|date of birth|birth ?date|DOB|geboren(?: am)?|Geburtsdatum|nacid[oa](?: el)?|fecha de nacimiento|né(?:e)?(?: le)?|date de naissance"
PASSPORT_WORDS = "passport|reisepass|pasaporte|passeport"
NATIONAL_WORDS = "ssn|social security|national insurance|sozialversicherung|seguridad social|sécurité sociale"
ACCOUNT_WORDS = "iban|account|konto|cuenta|compte"
_CAP, _LOW = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
WORD_NAME = f"{_CAP}(?:{_LOW}++(?:[-'’]{_CAP}?{_LOW}++)?|['’]{_CAP}{_LOW}++)"
NAME = rf"(?<=(?<![A-Za-zÀ-ÿ])(?:{TITLES})\.?\x20){WORD_NAME}(?:\x20{WORD_NAME})?|(?<=(?:{CALLED})\x20){WORD_NAME}(?:\x20{WORD_NAME})?|(?<![A-Za-zÀ-ÿ])(?:{FIRST_NAMES})\x20{WORD_NAME}"
ADDRESS = (
    rf"(?<![0-9.])[0-9]{{1,5}}\x20(?:{WORD_NAME}\x20){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)(?![A-Za-z])|"
    rf"(?<![A-Za-zÀ-ÿ]){_CAP}{_LOW}*+(?:-{_CAP}{_LOW}++)*(?<=straße|strasse|weg|platz|allee|gasse)\x20[0-9]{{1,4}}[a-z]?(?![0-9A-Za-z.])|"
    rf"(?<![A-Za-zÀ-ÿ])(?:Calle|Avenida|Plaza|Paseo)\x20(?:de\x20)?(?:l[ao]s?\x20)?{WORD_NAME}(?:\x20{WORD_NAME})?,?\x20[0-9]{{1,4}}(?![0-9.])|"
    rf"(?<![0-9.])[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard|place|quai|allée)\x20(?:d[eu]s?\x20)?(?:la\x20|l['’])?{WORD_NAME}(?:[\x20-]{WORD_NAME})?"
)
DATE = r"(?<![0-9./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])"
PASSPORT = rf"(?<=(?i:{PASSPORT_WORDS})[^0-9\n]{{1,16}})(?<![A-Za-z0-9])[A-Z]{{0,2}}[0-9]{{6,9}}[A-Z]?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ADDED = {"secret": TOKEN, "name": NAME, "address": ADDRESS, "birth": DATE, "passport": PASSPORT, "national": NATIONAL, "iban": IBAN}
#: What a text must hold before a kind's pattern is tried on it; long lists of words stand behind a look at the first letter.
GUARDS = {
    "secret": TOKEN, "name": rf"(?=[A-ZÀ-Þ])(?<![A-Za-zÀ-ÿ])(?:{TITLES}|{FIRST_NAMES})\.?\x20[A-ZÀ-Þ]|(?=[MmIiJjNn])(?:{CALLED})\x20[A-ZÀ-Þ]", "address": r"(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]|[0-9],?\x20(?:rue|avenue|boulevard|place|quai|allée)\x20|[0-9]\x20[A-Z][a-z]|(?:Calle|Avenida|Plaza|Paseo)\x20",
    "birth": r"[0-9][./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", "passport": f"(?i){PASSPORT_WORDS}", "national": NATIONAL, "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
}


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_blocks(items: Column) -> Column:
    """An array as an array of blocks of about the square root of its size, so that appending within blocks, and blocks to each
    other, stays far from the square of it."""
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, size)))


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Array of (start, end, hit) of the leftmost non-overlapping matches, in code points: what splitting leaves gives
    their places. Texts that fail the guard have none."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    pairs = let(hits, lambda found: F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("hit"))))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["hit"].alias("hit"))
        return F.struct((start + x["size"]).alias("at"), F.array_append(acc["out"], one).alias("out"))

    def placed(blocks: Column) -> Column:
        widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        firsts = F.aggregate(widths, start, lambda a, w: F.struct((a["at"] + w).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, firsts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    return F.when(guard, F.coalesce(let(pairs, lambda p: let(in_blocks(p), placed)), none)).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 1, F.try_element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.try_cast("int") + 1)).otherwise(d.try_cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits(hit)).between(14, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    guards = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"),
        "phone": text.contains("+"),
    }
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    passes = lambda k: lambda m: valid(k, m["hit"])
    return {k: F.filter(matches(text, p, guards[k]), passes(k)) for k, p in patterns.items()}


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def iban_holds(token: Column) -> Column:
    """Whether the check digits fit: the number read with its first four characters last leaves 1 of 97."""
    plain = F.regexp_replace(token, "\\x20", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    digit = lambda a, ch: F.when(ch.between("0", "9"), (a * 10 + ch.try_cast("int")) % 97).when(ch.between("A", "Z"), (a * 100 + F.ascii(ch) - 55) % 97).otherwise(a)
    return F.aggregate(F.split(turned, ""), F.lit(0), digit) == 1


def likely_date(token: Column) -> Column:
    """Whether a day and a month can be read, in whatever order."""
    parts = F.transform(F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    small_ = F.filter(parts, lambda x: x < 1000)
    return (F.array_min(small_) >= 1) & (F.array_min(small_) <= 12) & (F.array_max(small_) <= 31)


def judged(kind: str, token: Column, before: Column) -> dict[str, Column]:
    """Votes of the labelers (1, 0, or -1 for none) and further features of a candidate, each of a few values."""
    n = F.length(token)
    share = F.length(digits(token)) / n
    silent, no = F.lit(False), F.lit(False)
    after = lambda words: before.rlike(rf"(?i)(?:{words})[^.\n]{{0,12}}$")
    votes = {
        "secret": lambda: (
            vote(token.rlike(FORMATS), token.rlike(r"^[0-9/+-]+$")), vote(before.rlike(GAZETTEER), before.rlike(r"[A-Za-z]$|^$")), vote(before.rlike(ASSIGNED), before.rlike(PROSE)),
            vote(share.between(0.15, 0.9) & ~token.rlike(r"[/_-].*[/_-].*[/_-]"), (share < 0.1) | (share == 1)),
        ),
        "name": lambda: (
            vote(before.rlike(rf"(?:{TITLES})\.?\x20$"), no), vote(token.rlike(rf"^(?:{FIRST_NAMES})\x20"), no), vote(before.rlike(rf"(?:{CALLED})\x20$"), no), vote(token.rlike(rf"^{WORD_NAME}\x20{WORD_NAME}$"), token.rlike(f"^{_CAP}{_LOW}{{0,1}}$")),
        ),
        "address": lambda: (vote(token.rlike(ADDRESS), silent), vote(before.rlike(r"(?i)(?:address|adresse|dirección|live at|lives at|wohnt in|wohnhaft|vive en|habite)[^.\n]{0,12}$"), no), vote(before.rlike(r"(?:\x20|^)(?:at|in|an|en|au|to|nach|a)\x20(?:the\x20|der\x20)?$"), no), vote(share.between(0.02, 0.4), share > 0.6)),
        "birth": lambda: (vote(silent, ~after(BORN)), vote(after(BORN), ~after(BORN)), vote(after(BORN), before.rlike(PROSE)), vote(token.rlike("(?:19|20)[0-9]{2}"), no)),
        "passport": lambda: (vote(token.rlike("^[A-Z]{0,2}[0-9]{7,9}[A-Z]?$"), no), vote(after(PASSPORT_WORDS), no), vote(before.rlike(r"(?i)(?:no\.?|nr\.?|n°|number|nummer|número|numéro|is|ist|es|est|[:#])\x20?$"), no), vote(share > 0.6, share < 0.5)),
        "national": lambda: (vote(token.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), token.rlike("^(?:000|666|9)|-00-|-0000$")), vote(after(NATIONAL_WORDS), no), vote(before.rlike(r"[:#]\x20?$"), no), vote(silent, silent)),
        "iban": lambda: (vote(token.rlike("^[A-Z]{2}[0-9]{2}"), no), vote(after(ACCOUNT_WORDS), no), vote(before.rlike(r"[:#]\x20?$"), no), vote(n.between(15, 42), n < 15)),
    }[kind]()
    return {
        **dict(zip(LABELERS, votes, strict=True)),
        "size": F.when(n < 16, 3).when(n < 20, 0).when(n < 32, 1).otherwise(2),
        "share": F.when(share < 0.15, 0).when(share < 0.6, 1).when(share < 1, 2).otherwise(3),
        "upper": token.rlike("[A-Z]").cast("int"),
        "lower": token.rlike("[a-z]").cast("int"),
    }


def kept(docs: DataFrame, keep: tuple[str, ...]) -> tuple[str, ...]:
    """The columns to keep that docs has, without those named like a result's, whose place the result takes."""
    own = ("doc_id", *KINDS[:4], "candidates", "base", "spans")
    return tuple(c for c in dict.fromkeys(keep) if c in (*docs.columns, "text") and c not in own)


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, base spans and candidates with their votes, one row per document; no shuffle."""
    text = F.col("text")
    kinds = {"text": "string"} | dict(docs.dtypes)
    keep = kept(docs, keep)
    slim = columns_or_null(docs, **({c: kinds[c] for c in keep} | {"doc_id": "long", "text": "string"})).withColumn("text", F.coalesce("text", F.lit("")))
    spans = {k: F.transform(v, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(k) for k, v in base_spans(text).items()}

    def described(kind: str):
        def one(m: Column) -> Column:
            before = F.substring(text, F.greatest(m["start"] - BEFORE, F.lit(0)) + 1, F.least(m["start"], F.lit(BEFORE)))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *[v.alias(k) for k, v in judged(kind, m["hit"], before).items()])

        return one

    checks = {"iban": lambda m: iban_holds(m["hit"]), "birth": lambda m: likely_date(m["hit"])}
    spots = {kind: matches(text, pattern, text.rlike(GUARDS[kind])) for kind, pattern in ADDED.items()}
    found = [F.transform(F.filter(m, checks[kind]) if kind in checks else m, described(kind)) for kind, m in spots.items()]
    return slim.select("doc_id", *keep, *spans.values(), F.concat(*found).alias("candidates"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """Probability that each vote pattern is of a credential, by expectation-maximisation over the patterns' counts. Votes
    are independent given the truth; a labeler's abstaining is one of its three votes."""
    k = len(LABELERS)
    rate = 0.5
    start = [{t: {-1: 0.3, t: 0.7 - wrong, 1 - t: wrong} for t in (0, 1)} for wrong in STARTS_WRONG]
    table = start
    p = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (votes, _) in enumerate(patterns):
            a, b = log(rate), log(1 - rate)
            for j, v in enumerate(votes):
                a += log(table[j][1][v])
                b += log(table[j][0][v])
            p[i] = 1 / (1 + exp(max(-500.0, min(500.0, b - a))))
        total = sum(n for _, n in patterns)
        rate = min(0.99, max(0.01, sum(q * n for q, (_, n) in zip(p, patterns, strict=True)) / total))
        # the start counts as much as all votes together, so labelers that err together do not carry a sure one along
        table = [{} for _ in range(k)]
        for j in range(k):
            for t in (0, 1):
                mass = {v: 1.0 + total * start[j][t][v] for v in (-1, 0, 1)}
                for q, (votes, n) in zip(p, patterns, strict=True):
                    mass[votes[j]] += n * (q if t else 1 - q)
                whole = sum(mass.values())
                table[j][t] = {v: m / whole for v, m in mass.items()}
    return p


def logistic(cells: list[tuple[tuple[int, ...], float, int]], rounds: int = 300) -> tuple[float, dict[tuple[int, int], float]]:
    """Weights of the feature values, by gradient descent on cells of (feature values, probability, number)."""
    keys = sorted({(j, v) for values, _, _ in cells for j, v in enumerate(values)})
    w, bias, total = dict.fromkeys(keys, 0.0), 0.0, sum(n for _, _, n in cells)
    step = 4.0 / (len(FEATURES) + 1)
    for _ in range(rounds):
        g, g0 = dict.fromkeys(keys, 0.0), 0.0
        for values, q, n in cells:
            z = bias + sum(w[j, v] for j, v in enumerate(values))
            e = (1 / (1 + exp(-max(-500.0, min(500.0, z)))) - q) * n / total
            g0 += e
            for j, v in enumerate(values):
                g[j, v] += e
        bias -= step * g0
        for key in keys:
            w[key] -= step * (g[key] + 1e-4 * w[key])
    return bias, w


def train(found: DataFrame) -> dict[int, tuple[float, dict[tuple[int, int], float]]]:
    """A span classifier for every kind that has candidates."""
    cells = found.select(F.explode("candidates").alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in ("kind", *FEATURES)]).count().collect()  # at most the kinds by the product of the features' few values
    k, models = len(LABELERS), {}
    for kind in sorted({r["kind"] for r in cells}):
        own = [(tuple(r[1 : 1 + len(FEATURES)]), r["count"]) for r in cells if r["kind"] == kind]
        counts: dict[tuple[int, ...], int] = {}
        for values, n in own:
            counts[values[:k]] = counts.get(values[:k], 0) + n
        patterns = sorted(counts.items())
        belief = dict(zip([v for v, _ in patterns], reliabilities(patterns), strict=True))
        models[kind] = logistic(sorted((values, belief[values[:k]], n) for values, n in own))
    return models


def detect(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, base (array of start, end, kind number of the base spans) and spans (with the added ones), both in
    order of start, then of kind."""
    keep = kept(docs, keep)
    found = materialize(find(docs, keep), "spans")
    models = train(found)

    def tagged(name: str, array: Column) -> Column:
        return F.transform(array, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), m["end"].alias("end")))

    base = F.array_sort(F.concat(*[tagged(k, F.col(k)) for k in KINDS[:4]]))
    if not models:
        return found.select("doc_id", *keep, base.alias("base"), base.alias("spans"))

    def logit(c: Column) -> Column:
        out = F.lit(-1.0)
        for kind, (bias, weights) in models.items():
            own = reduce(lambda a, x: a + F.when(c[FEATURES[x[0][0]]] == x[0][1], x[1]).otherwise(0.0), weights.items(), F.lit(bias))
            out = F.when(c["kind"] == kind, own).otherwise(out)
        return out

    meets = lambda s, c: (s["start"] < c["end"]) & (c["start"] < s["end"])
    likely = F.filter("candidates", lambda c: (logit(c) > 0) & ~F.exists("base", lambda s: meets(s, c)))
    special = let(likely, lambda some: F.filter(some, lambda c: ~F.exists(some, lambda s: (s["kind"] > c["kind"]) & meets(s, c))))
    added = F.transform(special, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    return found.withColumn("base", base).select("doc_id", *keep, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """Documents (detected with their text kept) with every span replaced by its kind in brackets; of
    overlapping spans the first gives its name."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    kind = "struct<from:int,start:int,end:int,kind:int>"
    none = F.expr(f"cast(array() as array<{kind}>)")

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(acc["at"].alias("from"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))

    def parts(spans: Column) -> Column:
        """The text of a block's gaps with the names after them: from one piece of the text, cut once."""
        first = F.element_at(spans, 1)["from"]
        piece = F.substring(text, first + 1, F.element_at(spans, -1)["start"] - first)
        return let(piece, lambda p: F.array_join(F.transform(spans, lambda s: F.concat(F.substring(p, s["from"] - first + 1, s["start"] - s["from"]), F.element_at(names, s["kind"] + 1))), ""))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    folded = F.aggregate(in_blocks(F.col("spans")), start, block)
    whole = let(folded, lambda f: F.concat(F.array_join(F.transform(F.filter(f["out"], lambda b: F.size(b) > 0), parts), ""), F.substring(text, f["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("spans") == 0, text).otherwise(whole)).drop("base", "spans")
