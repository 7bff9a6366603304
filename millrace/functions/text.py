"""Text functions on columns: normalisers, tokenizers, parsers and sort keys. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stems of words too general to tell procurements apart, for contracts and for people.
CONTRACT_STEMS = ["оказан", "услуг", "выполнен", "работ", "закуп", "договор", "постав", "провед", "организац", "согласн"]
STAFF_STEMS = ["оказан", "услуг", "выполнен", "работ", "закуп", "договор", "постав", "провед", "организац"]
SPACE = r"[\s ]"


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def company_name(value: Column) -> Column:
    """Name for comparison: trimmed first, so one trailing space may come back from punctuation."""
    v = F.regexp_replace(text(value), rf"^{SPACE}+|{SPACE}+$", "")
    v = F.translate(F.lower(v), "ё ", "е ")
    v = F.regexp_replace(v, "[«»„“”\"']", "")
    v = F.regexp_replace(v, "[‐‑‒–—-]", " ")
    v = F.regexp_replace(v, r"[.,;:()\[\]{}]", " ")
    return F.regexp_replace(v, rf"{SPACE}+", " ")


def company_name_strict(value: Column) -> Column:
    """Name for storage: all that is neither letter nor digit is a space, fully trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text(value)), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def digits(value: Column) -> Column:
    return F.regexp_replace(text(value), "[^0-9]", "")


def valid_inn(value: Column, stored: Column | None = None) -> Column:
    """Blank, 10 or 12 digits, or the invalid value that is already stored."""
    good = F.trim(text(value)).rlike("^([0-9]{10}|[0-9]{12})?$")
    return good if stored is None else good | F.coalesce(value == stored, F.lit(False))


def _keywords(value: Column, stems: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(text(value)), F.lit("([a-zа-яё0-9-]+)"), F.lit(1))
    general = "^(" + "|".join(stems) + ")"
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.rlike(general))


def contract_keywords(value: Column) -> Column:
    return _keywords(value, CONTRACT_STEMS)


def staff_keywords(value: Column) -> Column:
    return F.array_distinct(_keywords(value, STAFF_STEMS))


def tokens(value: Column, least: int = 4) -> Column:
    """Distinct words of letters and digits of at least `least` characters, lower-cased."""
    found = F.regexp_extract_all(F.lower(text(value)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= least))


def contained(words: Column, searchable: Column) -> Column:
    """The distinct words that the text contains, as parts of words too."""
    return F.array_distinct(F.filter(words, lambda w: F.contains(searchable, w)))


def travel_ready(value: Column) -> Column:
    v = F.trim(F.lower(text(value)))
    no = (v == "") | (v == "нет") | v.rlike(r"не[\s ]+готов|невозмож|без[\s ]+командиров|командиров[^\s ]*[\s ]+нет")
    return ~no & v.rlike("да|готов|люб|возмож")


def number(value: Column) -> Column:
    """The first number of a text, with spaces between digits and a decimal comma or point; else 0."""
    found = F.regexp_extract(text(value), r"\d[\d\s ]*(?:[,.]\d+)?", 0)
    return F.coalesce(F.regexp_replace(F.regexp_replace(found, rf"{SPACE}", ""), ",", ".").try_cast("double"), F.lit(0.0))


def years(value: Column) -> Column:
    """The whole text as a number, else its first number, else 0."""
    v = text(value)
    whole = F.trim(F.regexp_replace(v, ",", ".")).try_cast("double")
    first = F.regexp_replace(F.regexp_extract(v, r"\d+(?:[.,]\d+)?", 0), ",", ".").try_cast("double")
    return F.coalesce(F.nullif(whole, F.lit(0.0)), F.nullif(first, F.lit(0.0)), F.lit(0.0))


def email(value: Column) -> Column:
    return F.regexp_extract(text(value), r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-zА-Яа-я]{2,}", 0)


def phone(value: Column) -> Column:
    return F.trim(F.regexp_extract(text(value), r"(?:\+7|8)[\d ()-]{9,}", 0))


def entries(value: Column) -> Column:
    """Entries between line ends and semicolons, without blank ones and "не указано"."""
    parts = F.transform(F.split(text(value), r"\r?\n|;"), lambda x: F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(parts, lambda x: (x != "") & ~x.rlike("(?iu)^не указано$"))


def is_yes(value: Column) -> Column:
    return F.trim(text(value)).rlike("(?iu)^(да|yes|true|1)$")


def summary(parts: list[Column], fallback: Column) -> Column:
    """The parts that aren't blank, joined by a middle dot, else the fallback."""
    known = F.filter(F.array(*[F.trim(text(p)) for p in parts]), lambda x: x != "")
    return F.when(F.size(known) > 0, F.array_join(known, " · ")).otherwise(text(fallback))


def escape_html(value: Column) -> Column:
    v = text(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def natural_key(value: Column) -> Column:
    """Sort key in lower case: runs of digits by value, each after its length, null as blank. Accents are left to a collation."""
    parts = F.regexp_extract_all(F.lower(F.translate(text(value.cast("string")), "ёЁ", "еЕ")), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 9, "0"), digits(p))).otherwise(p)), "")


def csv_cell(value: Column, delimiter: str = ";") -> Column:
    """A cell for CSV: formulas disarmed by an apostrophe, quoted where quotes, delimiters or line ends are inside."""
    v = F.when(text(value).rlike(r"^[\t\r\n ]*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(text(value))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike(rf'["{delimiter},\r\n]'), quoted).otherwise(v)


def tone(status: Column, tones: dict[str, str], default: str = "neutral") -> Column:
    """Looks a status up in a fixed map."""
    found = F.create_map(*[F.lit(x) for pair in tones.items() for x in pair])
    return F.coalesce(F.element_at(found, status), F.lit(default))


def safe_file_name(value: Column, other: str = "закупка") -> Column:
    """Runs of what is neither letter, digit, dot, underscore, blank nor hyphen become one underscore."""
    name = F.trim(F.regexp_replace(text(value), r"[^\p{L}\p{N}._ -]+", "_"))
    return F.when(name == "", other).otherwise(name)


def block_name(value: Column) -> Column:
    """Name of an output file: no .pdf at the end, none of the characters that file systems refuse, single blanks."""
    bare = F.regexp_replace(F.trim(text(value)), r"(?i)\.pdf$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "), r"[. ]+$", "")


def rubles(value: Column) -> Column:
    """Whole rubles with no-break spaces between thousands."""
    return F.concat(F.translate(F.format_number(F.floor(value + 0.5), 0), ",", "\u00a0"), F.lit("\u00a0₽"))


def fnv1a(value: Column) -> Column:
    """32 bits over the UTF-16 units of a text, as a hexadecimal text without leading zeros."""
    units = F.encode(value, "UTF-16BE")
    at = F.when(F.length(units) > 0, F.sequence(F.lit(1), F.greatest(F.length(units) - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    unit = lambda i: F.conv(F.hex(F.substring(units, i, F.lit(2))), 16, 10).cast("long")
    mask = F.lit(0xFFFFFFFF)
    folded = F.aggregate(at, F.lit(2_166_136_261).cast("long"), lambda h, i: (h.bitwiseXOR(unit(i)) * F.lit(16_777_619)).bitwiseAND(mask))
    return F.lower(F.hex(folded))
