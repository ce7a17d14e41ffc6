"""Column functions on text: prices, units, keys, labels, identities. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns and word lists of the quotation data -------------------------------------------------------
CURRENCIES = "aed|dhs|dh|usd"
UNIT_RULES = (
    (r"sq\s*\.?\s*m|sqm|m2|m\^2|square\s*met", "Sqm"),
    (r"\bday", "Days"),
    (r"\bhr|\bhour", "Hrs"),
    (r"\blump|\bl\.?s\.?\b|lumpsum", "Lump Sum"),
    (r"\bset", "Set"),
    (r"\bnos?\b|\bnumber", "Nos"),
    (r"\bpc|\bpiece|\beach|\bea\b|\bqty\b|\bunit\b", "Pcs"),
)
BLANK_UNITS = ("", "none", "nan", "-", "n/a")
LUMP_SUM_WORDS = "service|package|rental|lumpsum|lump sum"
CLIENT_SUFFIXES = ("llc", "l l c", "fzc", "fze", "fz llc", "ltd", "limited", "inc", "co", "company", "corp", "corporation", "est", "establishment", "trading", "general trading")
SERVICE_WORDS = r"(?i)\b(delivery|transport(ation)?|installation|install|crew|labour|labor|manpower|dismantl\w*|removal|freight|shipping|handling|rental|hire|supervis\w*|management fee|contingency|misc(ellaneous)?|sundr\w+|discount|vat|charges?|fees?)\b"
NUMERIC_ONLY = r"(?i)^[\s$€£]*[-+(]?[\d,.\s]+%?\)?\s*(aed|usd|eur|dhs?|dirhams?)?\s*[-+)]?\s*$"
DATE_ONLY = r"^\s*\d{1,4}\s*[-/.]\s*\d{1,2}\s*[-/.]\s*\d{1,4}\s*$"
FRAGMENT_WORDS = ("only", "as req", "as required", "items", "item", "each", "req", "note", "notes", "incl", "included", "excl", "etc", "and", "the", "for", "with", "na", "n/a", "tbc", "tbd", "yes", "no", "all", "new", "same", "total", "subtotal")
SPEC_START = r"(?i)^\s*([-•*]|\(|[LWHD]\s*\d|\d+\s*(mm|cm|m|sqm|ft)\b|measures\b|features\b|components\b|includes?\b)"
CORRECTABLE = ("rate", "unit", "venue")
# ------------------------------------------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; null stays null."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_rate(text: Column) -> Column:
    """A price as typed, as double; 0 where letters remain or no number can be read. Signs are dropped.

    A lone comma group of three digits marks thousands, any other a decimal comma."""
    bare = F.regexp_replace(F.lower(strip(text)), f"({CURRENCIES})", "")
    digits = F.regexp_replace(bare, r"[^0-9.,]", "")
    # commas beside a point, or before a last group of three, mark thousands; others are decimal commas
    plain = F.replace(F.regexp_replace(digits, r",(?=.*\.)|(?<=\.[0-9,]{0,40}),|,(?=(?:\d*,)*\d{3}$)", ""), F.lit(","), F.lit("."))
    return F.when(bare.rlike("[a-z]"), 0.0).otherwise(F.coalesce(plain.try_cast("double"), F.lit(0.0)))


def first_number(text: Column) -> Column:
    """The first number of a cell, thousands separators ignored; 0 where there is none."""
    return F.coalesce(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(0.0))


def number_range(text: Column) -> Column:
    """struct(low, high) of 'low - high' (hyphen or dash); one number is both ends; 0 and 0 where there is none."""
    found = F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    at = lambda i: F.coalesce(F.get(found, F.lit(i)).try_cast("double"), F.lit(0.0))
    return F.struct(at(0).alias("low"), F.when(F.size(found) > 1, at(1)).otherwise(at(0)).alias("high"))


def normalize_unit(unit: Column, description: Column) -> Column:
    """One of seven units by the first rule that fits; blank and symbol-only units follow the description."""
    raw = F.lower(F.coalesce(strip(unit), F.lit("")))
    fallback = F.when(F.lower(F.coalesce(description, F.lit(""))).rlike(LUMP_SUM_WORDS), "Lump Sum").otherwise("Pcs")
    out = F.when(raw.isin(*BLANK_UNITS), fallback)
    for pattern, name in UNIT_RULES:
        out = out.when(raw.rlike(pattern), name)
    return out.when(~raw.rlike("[a-z]"), fallback).otherwise("Pcs")


def client_key(name: Column) -> Column:
    """Case, punctuation and trailing company suffixes ignored; a name that is a suffix stays."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\w\s]", " "), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(s, rf"( ({'|'.join(CLIENT_SUFFIXES)}))+$", ""), " ", "")


def squeezed_key(name: Column) -> Column:
    """Letters, digits and underscores in lower case: the key of suppliers."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\w]", "")


def catalog_key(description: Column) -> Column:
    """Lower case words separated by one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), r"[^\w\s]", " "), r"\s+", " "))


def title_line(description: Column) -> Column:
    """The first line that isn't blank, or an empty string."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(description, "\n"), strip), lambda x: x != ""), F.lit(0)), F.lit(""))


def spec_lines(description: Column) -> Column:
    """The lines after the title, without blank ones."""
    lines = F.filter(F.transform(F.split(F.coalesce(description, F.lit("")), "\n"), strip), lambda x: x != "")
    return F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))


def phone_key(phone: Column) -> Column:
    """The last nine digits, or all where there are fewer."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 9, F.right(digits, F.lit(9))).otherwise(digits)


def content_id(file_name: Column, description: Column, rate: Column) -> Column:
    """Identity of an item by what it is: the same for the same file, description and rate, whatever its place."""
    clean = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.left(F.sha2(F.concat_ws("\u001f", clean(file_name), clean(description), F.format_string("%.4f", F.coalesce(rate.cast("double"), F.lit(0.0)))), 256), F.lit(32))


def is_service(description: Column) -> Column:
    """Whether the first line prices a service rather than a thing; a blank line does."""
    text = strip(F.coalesce(description, F.lit("")))
    return (text == "") | F.get(F.split(text, "\n"), F.lit(0)).rlike(SERVICE_WORDS)


def looks_like_description(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    core = F.lower(strip(F.regexp_replace(t, ":+$", "")))
    label = t.endswith(":") & (F.size(F.split(core, r"\s+")) <= 2)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(t) >= 3) & ~t.rlike(NUMERIC_ONLY) & ~t.rlike(DATE_ONLY) & (letters >= 3) & ~core.isin(*FRAGMENT_WORDS) & ~label


def looks_like_spec_line(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return (t != "") & (F.length(t) <= 160) & ~t.rlike(NUMERIC_ONLY) & ~t.rlike(DATE_ONLY) & (t.rlike(SPEC_START) | t.rlike(r"\d+\s*[xX]\s*\d+"))


def trailing_numbers(line: Column, most: int = 4) -> Column:
    """struct(numbers, rest): up to `most` price-like words off the right end, in reading order, and what is before them."""
    words = F.filter(F.split(strip(F.coalesce(line, F.lit(""))), r"\s+|\|"), lambda w: w != "")
    back = F.reverse(F.transform(words, lambda w: F.struct(w.alias("w"), clean_rate(w).alias("v"))))
    stop = F.coalesce(F.array_position(F.transform(back, lambda x: x["v"] <= 0), F.lit(True)), F.lit(0))
    n = F.least(F.when(stop > 0, stop - 1).otherwise(F.size(words)), F.lit(most)).cast("int")
    numbers = F.reverse(F.transform(F.slice(back, F.lit(1), n), lambda x: x["v"]))
    rest = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " "), r"^[ \-:|]+|[ \-:|]+$", "")
    return F.struct(numbers.alias("numbers"), rest.alias("rest"))


def title_case(text: Column) -> Column:
    """A capital after every character that isn't a letter, the rest in lower case: "o'neil jbr-2" -> "O'Neil Jbr-2"."""
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/*?:"<>|]', "")


def age_label(years: Column) -> Column:
    """today, n days, n months, or years and months."""
    days = F.round(years * 365.25).cast("int")
    months = F.round(years * 12).cast("int")
    whole, rest = F.floor(months / 12).cast("int"), months % 12
    long = F.when(rest > 0, F.format_string("%dy %dmo", whole, rest)).otherwise(F.format_string("%dy", whole))
    return F.when(days < 1, "today").when(days < 31, F.format_string("%d days", days)).when(months < 12, F.format_string("%d months", months)).otherwise(long)


def correction_fields(csv: Column) -> Column:
    """A comma-separated set of field names, unknown ones dropped, in alphabetical order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(csv, F.lit(""))), ","), strip), lambda x: x.isin(*CORRECTABLE))))


def share_summary(lines: Column, most: int = 5) -> Column:
    """The first line, to 60 characters, of up to `most` descriptions, and how many more there are."""
    shown = F.transform(F.slice(lines, 1, most), lambda x: F.concat(F.lit("- "), F.left(title_line(x), F.lit(60))))
    more = F.size(lines) - most
    return F.array_join(F.when(more > 0, F.array_append(shown, F.format_string("…and %d more", more))).otherwise(shown), "\n")


def share_link(phone: Column, text: Column) -> Column:
    return F.concat(F.lit("https://wa.me/"), F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", ""), F.lit("?text="), F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")))


def mail_link(to: Column, subject: Column, body: Column) -> Column:
    coded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("mailto:"), F.coalesce(to, F.lit("")), F.lit("?subject="), coded(subject), F.lit("&body="), coded(body))


def money(amount: Column) -> Column:
    """1,234.56"""
    return F.format_number(amount.cast("double"), 2)


def document_number(prefix: str, number: Column) -> Column:
    """PREFIX-0007: at least four digits."""
    return F.format_string(f"{prefix}-%04d", number)


def derived_code(category: Column, description: Column) -> Column:
    """CAT-DES-CRI: the first three letters of a category and of up to two words of a description, for entries without a code."""
    words = lambda c, n: F.slice(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z]{3,}"), F.lit(0)), 1, n)
    return F.array_join(F.transform(F.concat(words(category, 1), words(description, 2)), lambda w: F.upper(F.left(w, F.lit(3)))), "-")
