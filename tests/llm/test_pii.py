"""Surrogates: format, coreference, distinctness and hard rows."""

import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from unitflow.llm import pii

TEXTS = [
    "Mr. John Smith and Ms Smith; Mr Smith wrote to John.Smith@Mail.example.com or john.smith@mail.example.com",
    "call +1 (017) 555-7713 or +10175557713, not 12 or 2024-01-02",
    "card 4111 1111 1111 1111, 4111111111111111; ip 10.0.0.1 v 1.2.3.4.5 ssn 123-45-6789",
    "DE89 3704 0044 0532 0130 00 x",
    None,
    "",
    "Frau Müller иван.петров@почта.рф",
    "plain words, 42 and a.b",
]


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_formats_and_coreference(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, __hits string, core string")
    got = {r.doc_id: r for r in pii.replace(df, count_col="n").collect()}
    assert [got[i].n for i in range(len(TEXTS))] == [5, 2, 4, 1, 0, 0, 2, 0]
    assert got[4].text is None and got[5].text == "" and got[7].text == TEXTS[7] and got[0]["__hits"] == "x"
    title, given, surname = re.match(r"(Mr\.) (\w+) (\w+) and Ms (?=(\w+))", got[0].text).group(1, 2, 3)
    assert given.lower().endswith(tuple(pii.ENDS["given_m"])) and got[0].text.count(surname) == 3 and "Smith" not in got[0].text
    one, two = re.findall(r"\S+@\S+", got[0].text)
    assert one.lower() == two and one[0].isupper() and re.fullmatch(r"[a-z]{4}\.[a-z]{5}@[a-z]{4}\.[a-z]{7}\.[a-z]{3}", two)
    a, b = re.search(r"call (.*) or (\S+), not 12 or 2024-01-02", got[1].text).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)
    cards = re.search(r"card ([\d ]+), (\d+); ip ([\d.]+) v 1.2.3.4.5 ssn (\d{3}-\d{2}-\d{4})", got[2].text)
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111" and luhn(cards[2]) and cards[3] != "10.0.0.1" and cards[4] != "123-45-6789"
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d x", got[3].text) and got[3].text != TEXTS[3]
    number = got[3].text[:-2].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1
    assert re.fullmatch(r"Frau [A-Z]\w+ [а-я]{4}\.[а-я]{6}@[а-я]{5}\.[а-я]{2}", got[6].text)


def test_no_collisions(spark):
    """Short addresses collide at first; all distinct ones must end up apart, and no surrogate may be one of them."""
    df = spark.range(3000).select(F.concat(F.lit("a"), F.pmod("id", F.lit(60)).cast("string"), F.lit("@"), F.char(F.lit(97) + F.pmod("id", F.lit(26)).cast("int")), F.lit(".co")).alias("text"), "id")
    table = pii.surrogates(pii.entities(df)).collect()
    cores = [r.core for r in table]
    assert len(set(cores)) == len(cores) and not set(cores) & {r.norm for r in table}
    many = spark.range(4000).select(F.concat(F.lit("Mr X"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), "id")
    table = pii.surrogates(pii.entities(many)).collect()
    assert len({r.core for r in table}) == len(table) == 4000
    assert any(r.attempt for r in table)
    texts = [r.text for r in pii.replace(many.unionByName(many)).collect()]
    assert len(set(texts)) == 4000 and len(texts) == 8000
    cores = {r.norm: r.core for r in table}
    assert {t[3:].lower() for t in texts} == set(cores.values())


def test_longer_surrogates(spark):
    """After the last round surrogates of those that still collide get longer; none is an entity."""
    many = spark.range(20000).select(F.concat(F.lit("Mr X"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), "id")
    table = pii.surrogates(pii.entities(many), max_rounds=0).collect()
    assert len({r.core for r in table}) == len(table) == 20000 and any(r.attempt for r in table)
    assert not {r.core for r in table} & {r.norm for r in table}
    # All 900 numbers of a made space but for one digit: cores of that length are all taken.
    full = spark.createDataFrame([("phone", f"9{k:03d}") for k in range(1000)], "kind string, norm string")
    table = pii.surrogates(full, max_rounds=1).collect()
    assert len({r.core for r in table}) == 1000 and all(r.core.isdigit() and len(r.core) > 4 and r.core[0] == "9" for r in table)


def test_longer_surrogates_in_their_format(spark):
    hits = [("(555) 123-4567", "55512345678"), ("A.b@C.de", "qqx.y@z.uv"), ("1.2.3.4", "5.6.7.8.9"), ("123-45-6789", "9876543210"), ("Mr Lee", "braxton")]
    rows = [(h, c, "email" if "@" in h else "ip" if h.count(".") == 3 else "ssn" if h[3] == "-" else "surname" if h[0] == "M" else "phone") for h, c in hits]
    df = spark.createDataFrame(rows, "hit string, core string, kind string")
    cores = F.array(F.struct(F.col("kind"), F.col("core")))
    got = [r[0] for r in df.select(pii._written(F.col("hit"), cores)).collect()]
    assert got == ["(555) 123-45678", "qqX.y@Z.uv", "5.6.7.8.9", "987-65-43210", "Mr Braxton"]


@pytest.mark.parametrize("run", ["a@b.", "b.", "a@", "Ab/", "1234 ", "Mr X ", "DE89 3704 ", "+1 (555) ", "555-123-", "9", "a", "é."])
def test_no_text_ends_the_jvm(spark, run):
    text = "a@b." * (run == "b.") + run * ((1 << 15) // len(run))
    df = spark.createDataFrame([(text,), (text + " x@y.com",)], "text string")
    assert all(r.n >= 0 and r.text for r in pii.replace(df, count_col="n").collect())


def test_names_after_a_phrase(spark):
    df = spark.createDataFrame([("Hello, my name is Ann Lee. Ich heiße Ann, nicht Bob",), ("Mr Lee",)], "text string")
    one, two = (r.text for r in pii.replace(df).collect())
    given, surname, again = re.fullmatch(r"Hello, my name is (\w+) (\w+)\. Ich heiße (\w+), nicht Bob", one).groups()
    assert given == again != "Ann" and two == f"Mr {surname}" != "Mr Lee" and given.lower().endswith(tuple(pii.ENDS["given"]))


def brute_surrogate(hit, key=pii.KEY):
    """The surrogate of a match whose entities are all of the first attempt, and is no name."""
    kind = next((k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, hit, regex.V1)), "name")
    norm = hit.lower() if kind in ("email", "ip") else "".join(regex.findall(r"[\p{L}\p{N}]", hit)).lower()
    stream = hashlib.sha512(f"{key}|{kind}|{norm}|0".encode()).digest()
    other = lambda c, r: next((a[r % len(a)] for p, a in pii.ALPHABETS.items() if regex.search(p, c, regex.V1)), c)
    chars = "".join(other(c, stream[i % 64]) for i, c in enumerate(norm))
    if kind == "ip":
        return ".".join(str(1 + stream[k] % 254) for k in range(4))
    if kind in ("phone", "card"):
        chars = norm[0] + chars[1:]
    if kind == "card":
        chars = next(chars[:-1] + d for d in "0123456789" if luhn(chars[:-1] + d))
    if kind == "iban":
        chars = next(f"{norm[:2]}{k:02d}{chars[4:]}" for k in range(2, 99) if int("".join(str(int(c, 36)) for c in chars[4:] + norm[:2] + f"{k:02d}")) % 97 == 1)
    out, at = [], 0
    for c in hit:
        if kind == "email" or regex.match(r"[\p{L}\p{N}]", c):
            out.append(chars[at].upper() if c == c.upper() != c.lower() else chars[at])
            at += 1
        else:
            out.append(c)
    return "".join(out)


def test_query_by_brute_force(spark):
    """Every text of the table but those with names, whose surrogates are made of syllables; none of its entities is drawn again."""
    from unitflow.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, "DE89370400440532013000, GB82 WEST 1234 5698 7654 32", "x", "s", 0), (-2, "4111-1111-1111-1111 (555) 123-4567 10.1.2.3 a.b@c.de", "x", "s", 0), (-3, None, "x", "s", 0)], docs.schema)
    table = pii.surrogates(pii.entities(docs.union(extra)))
    assert table.where("attempt > 0").isEmpty()
    got = {r.doc_id: r for r in pii.replace(docs.union(extra).select("doc_id", "text"), count_col="n_replaced").collect()}
    assert {r.doc_id: r.n_replaced for r in queries.op8_pii(spark, "/root/testdata/sf0.01").collect()} == {i: r.n_replaced for i, r in got.items() if i >= 0}
    any_, compared, replaced = regex.compile(pii.ANY, regex.V1), 0, 0
    for r in docs.union(extra).collect():
        hits = any_.findall(r.text or "")
        assert got[r.doc_id].n_replaced == len(hits)
        if r.text is None or any(regex.fullmatch(pii.PATTERNS["name"], h, regex.V1) for h in hits):
            continue
        assert got[r.doc_id].text == any_.sub(lambda m: brute_surrogate(m[0]), r.text)
        compared, replaced = compared + 1, replaced + len(hits)
    assert compared > 900 and replaced > 50


def test_key_decides(spark):
    df = spark.createDataFrame([("me@example.com",)], "text string")
    one, again, other = (pii.replace(df, key=k).first().text for k in ("a", "a", "b"))
    assert one == again != other


def test_other_scripts(spark):
    """Scripts with and without an alphabet of their own: every address and name is replaced, and none stops the job."""
    found = ["사용자@도메인.한국", "محمد@مثال.شبكة", "שלום@דואר.ישראל", "ሰላም@ሰላም.ኢትዮ", "Պետրոսյան", "ᎠᎡᎢ@ᎣᎤ.ᎥᎦ", "სახლი@ფოსტა.გე"]
    df = spark.createDataFrame([(f"to {'Mr ' if '@' not in x else ''}{x} now",) for x in found], "text string")
    table = pii.surrogates(pii.entities(df)).collect()
    assert len(table) == len(found) and not {r.core for r in table} & {r.norm for r in table}
    texts = [r.text for r in pii.replace(df).collect()]
    assert all(x not in "".join(texts) for x in found)
    assert re.fullmatch(r"to [가-힣]{3}@[가-힣]{3}\.[가-힣]{2} now", texts[0]) and re.fullmatch(r"to [ء-ي]{4}@[ء-ي]{4}\.[ء-ي]{4} now", texts[1])
