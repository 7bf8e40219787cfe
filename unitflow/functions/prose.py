"""Which keys and values of data files are for people, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitflow.functions import scripts

# Names and ends of keys whose values programs read, and words that stand for values.
MACHINE_KEYS = (
    "id uuid guid key type kind class nameid code script style path file filename directory dir url uri href src link email hash checksum token secret "
    "password regex pattern command format encoding locale language version date time color colour font resource asset ref identifier slug handle enum mime address"
).split()
MACHINE_ENDS = ("_id", "_path", "_url", "_key", "_file")
CAPITAL_ENDS = ("Id", "ID", "Path", "Url", "URL", "File", "Key", "Token", "Hash")
VALUES = "true false null none nil yes no on off nan inf".split()


def machine_key(key: Column) -> Column:
    """Whether a key names something for programs: by its last part, or by how it ends."""
    last = F.lower(F.regexp_extract(key, r"[^.:/-]*$", 0))
    return last.isin(*MACHINE_KEYS) | last.rlike(f"(?:{'|'.join(MACHINE_ENDS)})$") | key.rlike(f"(?:{'|'.join(CAPITAL_ENDS)})$")


def human_text(text: Column) -> Column:
    """Whether a value reads like text: it has letters, is no number, address, path, code, hexadecimal string or name of a program's own."""
    return scripts.let(scripts.trim(text), _human)


def _human(t: Column) -> Column:
    number = t.rlike(r"(?i)^[+-]?(?:inf(?:inity)?|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$")
    code = t.rlike(r"://|@|[\\/{}`<>]|=>|==|^(?:www\.|[/\\.$%])")
    control = t.rlike(r"[\p{Cc}&&[^\n\r\t]]")
    hexadecimal = t.rlike(r"^[0-9A-Fa-f-]{8,}$")
    word = ~t.rlike(r"(?U)\s") & ~t.rlike(r"[^\x00-\x7F]")
    capitals = ~t.rlike("[a-z]") & t.rlike("[A-Z][^A-Z]*[A-Z]")
    own_name = word & (t.rlike(r"[-_.:=+\[\]0-9]") | capitals | t.rlike("[a-z][A-Z]"))
    return t.rlike(r"\p{IsAlphabetic}") & ~(F.lower(t).isin(*VALUES) | number | code | control | hexadecimal | own_name)
