"""Base spans against Python's patterns, credentials by weak supervision, redaction."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parallaxis.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base(x):
    x, out = x or "", []
    number = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(number(m)) <= 19 and luhn(number(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(number(m)) <= 15),
    )
    for k, (name, pattern, good) in enumerate(kinds):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, x) if good(m)]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return {r[0]: (r[1], r[2]) for r in pii.detect(df).select("doc_id", pii.listed("base"), pii.listed("spans")).collect()}


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(alphabet="a1.@+-_ 0459()é%\n", max_size=60), min_size=20, max_size=40))
def test_any_text(spark, texts):
    got = found(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [base(t) for t in texts]


def test_known_cases(spark):
    texts = [
        None, "", "mail a.b@c.de, x@y.z_d@e.fg and é@u.v", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.001 " + "9" * 400 + ".1.1.1",
        "4111 1111-1111 1111 and 41111111111111112 and 4111  1111", "+1 (743) 555-3824, +49 30 1234 5678 +1 2 +123456789012345678", "1" * 100_000, "a" * 100_000 + "@x.y", "a.b" * 20_000 + "@c.d",
        "x@" + "a." * 20_000 + "z", "+1" + " " * 50_000 + "2",
    ]
    got = found(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == [base(t) for t in texts]


def test_credentials_are_added(spark):
    prose = [f"plain words number {i} and isbn9781234567897xx{i} or 1234567890123456{i % 10} in the text" for i in range(60)]
    keys = [f"then password=7602ad27cf5550de1c{i:02d} ok" for i in range(20)] + [f'the token = "0cab398dc11d1a2a11dc6572c8df8bd228c864{i:02d}" x' for i in range(20)] + [f"and AKIA447BD7EW7YT55J{i:02d} seen" for i in range(20)]
    got = found(spark, prose + keys)
    hit = [i for i in got if "secret:" in got[i][1]]
    assert set(hit) >= set(range(60, 120)) and not [i for i in hit if i < 60]
    assert all(set(got[i][0].split(",")) - {""} <= set(got[i][1].split(",")) for i in got), "base spans stay"


def test_redaction_and_columns(spark):
    rows = [(1, "write a@b.cd or +1 (743) 555-3824 é", "de", 3), (2, None, None, None), (3, "nothing", "en", 1), (None, "1.2.3.4", "en", 1), (3, "nothing", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind int")
    out = sorted(map(tuple, pii.redact(pii.detect(df, keep=("text", "lang", "kind"))).collect()), key=str)
    assert out == sorted([(1, "write [EMAIL] or [PHONE] é", "de", 3), (2, "", None, None), (3, "nothing", "en", 1), (None, "[IP]", "en", 1), (3, "nothing", "en", 1)], key=str)
    assert pii.detect(df.limit(0)).count() == 0


def test_the_plan_has_no_python(spark):
    plan = pii.detect(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")).withColumn("s", pii.listed("spans"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_reliabilities_side_with_the_majority():
    p = pii.reliabilities([((1, 1, 1, 1), 50), ((0, 0, 0, 0), 50), ((1, 1, -1, 1), 20), ((0, -1, 0, 0), 20)])
    assert p[0] > 0.9 and p[2] > 0.9 and p[1] < 0.1 and p[3] < 0.1
    assert F is not None


def test_credentials_of_any_length_and_mix(spark):
    prose = [f"plain words number {i}, the secret: of it and a token of love" for i in range(60)]
    keys = ["password: hunter2secret9", "api_key=abc123def456", "passphrase = correct-horse-battery", 'pwd="S3cret!x"', "x " + "k" * 60 + "7" + "f" * 10 + " password=" + "z" * 50 + "9"] * 8
    got = found(spark, prose + keys)
    hit = [i for i in got if "secret:" in got[i][1]]
    assert set(hit) >= set(range(60, 100)) and not [i for i in hit if i < 60]


def test_columns_that_clash_are_left_out(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "x", "y")], "doc_id long, text string, email string, spans string")
    out = pii.detect(df, keep=("text", "email", "spans", "missing"))
    assert out.columns == ["doc_id", "text", "base", "spans"] and out.count() == 1


PLANTED = {
    "name": ["I met Mr. {v} there", "Frau {v} kam gestern", "La Señora {v} vino", "Hello, my name is {v} and I", "je m'appelle {v} et je"],
    "address": ["We live at {v} since May", "Sie wohnt in der {v} seit Mai", "Vive en {v} desde mayo"],
    "birth": ["He was born on {v} in town", "Geburtsdatum: {v} steht da", "fecha de nacimiento: {v} dice", "née le {v} en ville"],
    "passport": ["My passport number is {v} now", "Reisepass Nr. {v} gilt", "pasaporte: {v} vale"],
    "national": ["SSN: {v} is on file", "his social security number {v} was", "the number {v} was written"],
    "iban": ["Please pay to IBAN {v} today", "Konto: {v} bitte", "we used {v} for it"],
    "secret": ["password = {v} is set", 'token="{v}" here', "passphrase: {v} now"],
}


def iban(country, account):
    n = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{country}{98 - n % 97:02d}{account}"


def plant(draw):
    """Texts with one value each, and the value's place: (text, kind, start, end)."""
    pick = draw.choice
    names = ["Anna Weber", "John Smith", "Lucía Gómez", "Pierre Dubois", "Peter O'Neil", "Claire Petit"]
    streets = {"We": ["12 Baker Street", "7 Old Mill Road"], "Sie": ["Lindenstraße 14", "Marktplatz 3"], "Vi": ["Calle de la Luna 15", "Avenida Real, 8"]}
    for kind, frames in PLANTED.items():
        for frame in frames:
            for _ in range(8):
                day, month, year, digits = draw.randrange(1, 29), draw.randrange(1, 13), draw.randrange(1930, 2005), "".join(draw.choices("0123456789", k=40))
                value = {
                    "name": pick(names), "address": pick(next((x for k, x in streets.items() if frame.startswith(k)), ["-"])), "birth": pick([f"{day}.{month}.{year}", f"{day:02d}/{month:02d}/{year}", f"{year}-{month:02d}-{day:02d}"]),
                    "passport": pick([f"C{digits[:8]}", digits[:9]]), "national": f"{draw.randrange(100, 600)}-{draw.randrange(10, 99)}-{draw.randrange(1000, 9999)}", "iban": pick([iban("DE", digits[:18]), iban("FR", digits[:23]), iban("ES", digits[:20])]),
                    "secret": "".join(draw.choices("abcdefghkmnpqrstuvwxyz", k=7)) + digits[:4],
                }[kind]
                lead = pick(["", "Some words before. ", "Ein Satz zuvor. "])
                start = len(lead) + frame.index("{v}")
                yield lead + frame.replace("{v}", value), kind, start, start + len(value)


CLEAN = ["The meeting is on 12.05.2021 in room 14.", "We sold 12 Red Apples and 30 pears.", "Order 123-45-678 was sent.", "Version 2020-13-45 is no date.", "Herr des Hauses war niemand.", "Der Weg 3 km weit.", "Account AB12 is closed.", "DE00 1234 5678 9012 3456 78 has wrong check digits.", "The Street was long.", "Der Reisepass liegt hier.", "La plaza es grande.", "In 1999 he had 12 rooms."]


def test_planted_spans_of_every_kind(spark):
    """Recall of 0.9 or more of each kind, and nothing else but a few spans, in texts that hold one value each and in texts that
    hold none."""
    import random

    planted = list(plant(random.Random(4)))
    texts = [t for t, *_ in planted] + CLEAN * 5
    out = {r["doc_id"]: r["listed"] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).select("doc_id", pii.listed("spans").alias("listed")).collect()}
    found = {i: {tuple(x.split(":")) for x in spans.split(",") if x} for i, spans in out.items()}
    hit, all_of = {k: 0 for k in PLANTED}, {k: 0 for k in PLANTED}
    for i, (_, kind, start, end) in enumerate(planted):
        all_of[kind] += 1
        hit[kind] += (kind, str(start), str(end)) in found[i]
    assert all(hit[k] >= 0.9 * all_of[k] for k in PLANTED), (hit, all_of)
    right, all_found = sum(hit.values()), sum(map(len, found.values()))
    assert right >= 0.97 * all_found, [(texts[i], x) for i, x in found.items() if len(x) > 1 or (i >= len(planted) and x)]
    assert not any(found[i] for i in range(len(planted), len(texts))), [(texts[i], found[i]) for i in range(len(planted), len(texts)) if found[i]]


def test_many_spans_of_a_long_text(spark):
    """A text of megabytes: spans are placed and replaced in blocks, not one after the other onto one array."""
    n = 30_000
    text = " ".join(f"a{i}@mail.example.com" for i in range(n)) + " x" * 1_000_000
    rows = pii.redact(pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=("text",))).collect()
    assert rows[0]["text"] == " ".join(["[EMAIL]"] * n) + " x" * 1_000_000
