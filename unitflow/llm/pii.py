"""Personal data replaced by surrogates.

Email addresses, IP addresses, IBANs, payment cards, social-security numbers, telephone numbers, and names after a title or a phrase by which
someone gives their name, are found by one pattern. An entity's normal form (lower case, or letters and digits alone) and a key decide its surrogate: characters of the same
script and case in the same places, a card or an IBAN with valid check digits, an address with valid octets, a given name of the
title's gender (or of none, after a phrase). The same entity gets the same surrogate wherever and however it is written. All distinct entities are
checked together: where two would share a surrogate, or a surrogate is itself an entity, all but the first draw
again until none collide. Where a space is so full that some still collide after MAX_ROUNDS rounds, their surrogates get a character
longer with each further round, so none is ever another entity. DataFrame functions only.

A null text stays null. Texts of any length are replaced whole; the domain of an address ends after 65 labels at most. Rows that repeat are replaced each; ids may be null; an empty table gives an empty result; an
extra column whose name an operator uses is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.shared import free_name, materialize

KEY = "unitflow"
MALE = "Mr|Herr|Monsieur|Señor"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora"
INTRODUCED = "[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es"
CUE = rf"(?:(?:{MALE}|{FEMALE})\.?|{INTRODUCED}) "
_FREE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: The kinds of entities in the order in which a place is tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,64}\.\p{L}{2,}",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[\p{L}\p{N}])",
    "iban": _FREE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": _FREE + r"(?:[0-9]{4}[ -]?){3}[0-9]{1,7}" + _END,
    "ssn": _FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[ .-]?[0-9]{2,4}){1,4}|\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4})" + _END,
    "name": _FREE + CUE + r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[0-9@]|{CUE}\p{{Lu}}"
MAX_ROUNDS = 30
#: Bits of the filter that tells which texts may hold a redrawn entity, and of each of its parts.
FILTER_BITS, PART_BITS = 1 << 23, 1 << 15
#: Characters that may stand for another: of the same script and case, or Latin ones for a script that is not listed, so that a redraw always
#: draws every letter and digit anew.
ALPHABETS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\p{IsLatin}&&\p{Ll}]": "àâäåæçèéêëîïñòóôöøùûüœßáíú",
    r"[\p{IsLatin}&&\p{Lu}]": "ÀÂÄÅÆÇÈÉÊËÎÏÑÒÓÔÖØÙÛÜŒÁÍÚ",
    r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя",
    r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsHan}": "安白陈东方高何江金李林马明平田王文武小新杨张中周",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにのはまみもやゆよりるれ",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニノハマミモヤユヨリルレ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하고노도로모보소오조주지기미시은정",
    r"[\p{IsArabic}&&\p{L}]": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"[\p{IsHebrew}&&\p{L}]": "אבגדהוזחטיכלמנסעפצקרשת",
    r"[\p{IsArmenian}&&\p{Ll}]": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ",
    r"[\p{IsArmenian}&&\p{Lu}]": "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՓՔՕՖ",
    r"[\p{IsThai}&&\p{L}]": "กขคงจฉชซญดตถทธนบปผพฟภมยรลวศสหอ",
    r"[\p{IsDevanagari}&&\p{L}]": "अकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    # Letters and digits of all other scripts
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{N}": "0123456789",
}
ONSETS = "b br c d dr f g gr h j k l m n p r s st t tr v w".split()
VOWELS = "a e i o u".split()
ENDS = {"given_m": "an as el en ian in on or us yn".split(), "given_f": "a ana ea elle ena ia ie ina ine ora".split(), "given": "ay el ey is lin ray sy".split(), "surname": "berg dale ford ham ley man mont ner stein ton well wood".split()}


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once and named once in the plan."""
    return F.transform(F.array(value), body)[0]


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal stream, which repeats."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], r: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(r, F.lit(len(values))) + 1)


def _other(c: Column, r: Column) -> Column:
    """A character of the same script and case; what is no letter or digit stays."""
    out = None
    for pattern, letters in ALPHABETS.items():
        one = F.substring(F.lit(letters), F.pmod(r, F.lit(len(letters))) + 1, F.lit(1))
        out = F.when(c.rlike(pattern), one) if out is None else out.when(c.rlike(pattern), one)
    return out.otherwise(c)


def _core(kind: Column, norm: Column, attempt: Column, key: str, longer: Column | None = None) -> Column:
    """The surrogate of a normal form, by so many characters longer: before an address, after anything else."""
    drawn = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 512)
    if longer is None:
        own, more = norm, F.lit("")
    else:
        own = F.when(kind == "email", F.concat(F.repeat(F.lit("a"), longer), norm)).otherwise(F.concat(norm, F.repeat(F.right(norm, F.lit(1)), longer)))
        more = F.repeat(F.lit("0"), longer)
    return _let(drawn, lambda stream: _let(F.array_join(F.transform(F.split(own, ""), lambda c, i: _other(c, _byte(stream, i))), ""), lambda chars: _of_kind(kind, own, attempt, stream, chars, more)))


def _of_kind(kind: Column, norm: Column, attempt: Column, stream: Column, chars: Column, longer: Column) -> Column:
    """chars, the normal form with other characters, or what a kind asks for instead; longer: a character for each one that names and
    addresses of machines get besides."""
    added = lambda one: F.array_join(F.transform(F.split(longer, ""), lambda c, i: F.when(c != "", one(i + 16)).otherwise("")), "")
    tail = lambda n: F.substring(chars, F.lit(n), F.char_length(norm))
    phone = F.concat(F.substring(norm, F.lit(1), F.lit(1)), tail(2))
    country = F.substring(norm, F.lit(1), F.lit(2))
    iban = _let(tail(5), lambda body: F.concat(country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body))
    octet = lambda k: (1 + F.pmod(_byte(stream, k), F.lit(254))).cast("string")
    octets = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), octet), "."), added(lambda k: F.concat(F.lit("."), octet(k))))
    r = lambda k: _byte(stream, F.lit(k))
    more = F.when(attempt > 0, F.concat(_pick(ONSETS, r(8)), _pick(VOWELS, r(9)))).otherwise(F.lit(""))  # more names once these run out
    syllables = F.concat(_pick(ONSETS, r(0)), _pick(VOWELS, r(1)), _pick(ONSETS, r(2)), _pick(VOWELS, r(3)), more, _pick(ONSETS, r(4)))
    ends = F.coalesce(*(F.when(kind == k, _pick(v, r(5))) for k, v in ENDS.items()))
    named = F.when(kind.isin(*ENDS) & norm.rlike(r"^\p{IsLatin}+$"), F.concat(syllables, added(lambda k: F.concat(_pick(VOWELS, _byte(stream, k)), _pick(ONSETS, _byte(stream, k + 32)))), ends))
    card = _let(F.left(phone, F.char_length(norm) - 1), lambda body: F.concat(body, _check_digit(body)))
    return F.when(kind == "ip", octets).when(kind == "iban", iban).when(kind == "card", card).when(kind == "phone", phone).otherwise(F.coalesce(named, chars))


def _check_digit(body: Column) -> Column:
    """The digit that makes a card number's weighted sum a multiple of ten."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(digits, F.lit(0), lambda s, d: s + d), F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's letters and digits, letters as two digits from 10 for a."""
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - F.ascii(F.lit("a")) + 10)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c), F.lit(97)))


def _kind(hit: Column) -> Column:
    out = F.when(hit.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for k in ("ip", "iban", "card", "ssn", "phone"):
        out = out.when(hit.rlike(f"^(?:{PATTERNS[k]})$"), k)
    return out.otherwise("name")


def _names(hit: Column) -> Column:
    """The one or two names of a match that begins with a cue."""
    return F.split(F.regexp_replace(hit, f"^{CUE}", ""), " ")


def _parts(hit: Column) -> Column:
    """The (kind, norm) of each entity in a match: one, or those of a given name and a surname. One name alone is a surname after a title."""
    kind, names = _kind(hit), _names(hit)
    given = F.when(hit.rlike(rf"^(?:{FEMALE})\.? "), "given_f").when(hit.rlike(rf"^(?:{MALE})\.? "), "given_m").otherwise("given")
    one = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    two = F.array(one(given, F.lower(names[0])), one(F.lit("surname"), F.lower(F.get(names, F.lit(1)))))
    alone = F.array(one(F.when(given == "given", given).otherwise("surname"), F.lower(names[0])))
    norm = F.when(kind.isin("email", "ip"), F.lower(hit)).otherwise(F.lower(F.regexp_replace(hit, r"[^\p{L}\p{N}]", "")))
    return F.when(kind == "name", F.when(F.size(names) > 1, two).otherwise(alone)).otherwise(F.array(one(kind, norm)))


def _name_of(entity: Column) -> Column:
    return F.concat_ws(":", entity["kind"], entity["norm"])


def _shaped(like: Column, core: Column) -> Column:
    """core in the case of like: all capitals, or a capital first."""
    return F.when(like == F.upper(like), F.upper(core)).otherwise(F.concat(F.upper(F.substring(core, F.lit(1), F.lit(1))), F.substring(core, F.lit(2), F.char_length(core))))


def _surrogate(hit: Column, redrawn: Column, key: str) -> Column:
    """The replacement of a match; redrawn maps entities to their surrogates where these are not those of the first attempt."""
    core = lambda e: F.struct(e["kind"].alias("kind"), F.coalesce(F.try_element_at(redrawn, _name_of(e)), _core(e["kind"], e["norm"], F.lit(0), key)).alias("core"))
    return _let(F.transform(_parts(hit), core), lambda cores: _written(hit, cores))


def _written(hit: Column, cores: Column) -> Column:
    """A match with the surrogates of its entities in its own format."""
    kind, core, names = cores[0]["kind"], cores[0]["core"], _names(hit)
    cased = lambda c, s: F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(s)).otherwise(s)
    base = F.char_length(F.when(kind == "email", F.lower(hit)).otherwise(F.lower(F.regexp_replace(hit, r"[^\p{L}\p{N}]", ""))))
    before = F.when(kind == "email", F.greatest(F.char_length(core) - base, F.lit(0))).otherwise(0)
    rank = lambda i: F.char_length(F.regexp_replace(F.substring(hit, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    place = lambda i: F.when(kind == "email", i + 1 + before).otherwise(rank(i))
    put = F.transform(F.split(hit, ""), lambda c, i: F.when((kind == "email") | c.rlike(r"[\p{L}\p{N}]"), cased(c, F.substring(core, place(i), F.lit(1)))).otherwise(c))
    named = F.concat_ws(" ", _shaped(names[0], core), F.when(F.size(names) > 1, _shaped(F.get(names, F.lit(1)), F.get(cores, F.lit(1))["core"])))
    named = F.concat(F.regexp_extract(hit, f"^{CUE}", 0), named)
    return F.when(kind == "ip", core).when(kind.isin(*ENDS), named).otherwise(F.concat(F.left(core, before), F.array_join(put, ""), F.when(kind == "email", "").otherwise(F.substring(core, base + 1, F.char_length(core)))))


def _hits(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct entities of all texts: kind and norm."""
    df = docs.select(_hits(F.col(text_col).cast("string")).alias("hits")).where(F.size("hits") > 0)
    return df.select(F.explode(F.array_distinct(F.flatten(F.transform("hits", _parts)))).alias("e")).select("e.kind", "e.norm").distinct()


def surrogates(found: DataFrame, key: str = KEY, max_rounds: int | None = None) -> DataFrame:
    """kind, norm, attempt and core of each distinct entity; no two of a kind share a core, and no core is an entity of its kind.

    Rounds end when nothing collides; each writes the table of distinct entities to the shared folder. After max_rounds each makes the room for
    those that still collide many times as large.
    """
    limit = MAX_ROUNDS if max_rounds is None else max_rounds
    table = materialize(found.withColumn("attempt", F.lit(0)).withColumn("core", _core(F.col("kind"), F.col("norm"), F.lit(0), key)), "surrogates")
    real = table.select("kind", F.col("norm").alias("core")).distinct()
    n = 0
    while True:
        first = table.groupBy("kind", "core").agg(F.min(F.struct("attempt", "norm"))["norm"].alias("owner"), F.count("*").alias("n"))
        taken = first.join(real.withColumn("real", F.lit(True)), ["kind", "core"], "left").where((F.col("n") > 1) | F.col("real"))
        taken = materialize(taken.select("kind", "core", "owner", F.coalesce("real", F.lit(False)).alias("real")), "collisions")
        if taken.isEmpty():
            return table
        again = F.coalesce(F.col("owner").isNotNull() & (F.col("real") | (F.col("owner") != F.col("norm"))), F.lit(False))
        df = table.join(taken, ["kind", "core"], "left").select("kind", "norm", "attempt", "core", again.alias("again"))
        attempt = F.col("attempt") + F.col("again").cast("int")
        df = df.select("kind", "norm", attempt.alias("attempt"))
        n += 1
        longer = F.greatest(F.col("attempt") - limit, F.lit(0)) if n > limit else None
        table = materialize(df.withColumn("core", _core(F.col("kind"), F.col("norm"), F.col("attempt"), key, longer)), "surrogates")


def _bit(entity: Column) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(FILTER_BITS)).cast("int")


def _filter_of(redrawn: DataFrame) -> DataFrame:
    """One row: bitmaps by part of the filter's bits that the redrawn entities set; at most FILTER_BITS bits, however many entities."""
    parts = redrawn.select(_bit(F.col("entity")).alias("bit")).groupBy(F.floor(F.col("bit") / PART_BITS).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(PART_BITS)).cast("long")).alias("bits"))
    return parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("bits"))


def _may_be_redrawn(entity: Column, filter_: Column) -> Column:
    bits = F.try_element_at(filter_, F.floor(_bit(entity) / PART_BITS).cast("int"))
    at = F.pmod(_bit(entity), F.lit(PART_BITS))
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """The rows and columns of docs with surrogates in the text; with count_col also the number of places replaced.

    Surrogates of the first attempt follow from the text alone. Texts that hold a redrawn entity are joined with those of its
    surrogates, by a hash of their text; a filter of bounded size keeps all but a few others from that shuffle.
    """
    text = F.col(text_col).cast("string")
    redrawn = surrogates(entities(docs, text_col), key).where("attempt > 0").select(F.concat_ws(":", "kind", "norm").alias("entity"), "core")
    hash_, map_, hits, new, may = (free_name(docs, f"__{n}") for n in ("hash", "redrawn", "hits", "new", "may"))
    df = docs.withColumn(hits, _hits(text))
    named = lambda found: F.array_distinct(F.transform(F.flatten(F.transform(found, _parts)), _name_of))
    none = F.lit(None).cast("map<string,string>")
    if redrawn.isEmpty():
        df = df.withColumn(map_, none)
    else:
        redrawn = materialize(redrawn, "redrawn")
        # The filter is a scalar subquery: one value, fetched once and sent with the tasks.
        df = df.withColumn(may, _filter_of(redrawn).scalar()).withColumn(may, F.exists(named(F.col(hits)), lambda e: _may_be_redrawn(e, F.col(may))))
        some = df.where(may).withColumn(hash_, F.md5(text))
        rows = some.select(hash_, F.explode(named(F.col(hits))).alias("entity")).distinct()
        maps = rows.join(redrawn, "entity").groupBy(hash_).agg(F.map_from_entries(F.collect_list(F.struct("entity", "core"))).alias(map_))
        df = some.join(maps, hash_, "left").drop(hash_).unionByName(df.where(~F.col(may)).withColumn(map_, none))
    df = df.withColumn(new, F.when(F.size(hits) > 0, F.transform(hits, lambda h: _surrogate(h, F.col(map_), key))))
    woven = F.array_join(F.transform(F.split(text, ANY), lambda p, i: F.concat(p, F.coalesce(F.get(F.col(new), i), F.lit("")))), "")
    replaced = F.when(F.col(new).isNull(), text).otherwise(woven)
    return df.select(*((replaced if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns), *([F.size(hits).cast("long").alias(count_col)] if count_col else []))
