"""Readers of dates, amounts, numbers and identifiers in Italian business text, as column expressions.

A reader returns the canonical value (text), or null where the text doesn't start with such a value close enough.
`window` is the greatest number of characters before the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfacts.functions.text import let

#: Fixed values.
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]
CURRENCIES = {"€": "EUR", "euro": "EUR", "eur": "EUR", "$": "USD", "dollaro": "USD", "dollari": "USD", "usd": "USD", "£": "GBP", "sterlina": "GBP", "sterline": "GBP", "gbp": "GBP", "franchi": "CHF", "franco": "CHF", "chf": "CHF"}
PIVOT_YEAR = 69
SAME_LINE_WINDOW, NEXT_LINE_WINDOW, MOST_TEXT = 40, 10, 200

B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # ASCII word boundaries, also beside accented letters
ISO = B + r"(\d{4})-(\d{2})-(\d{2})" + E
DMY = B + r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})" + E
TEXTUAL = "(?i)" + B + r"(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})" + E
MONEY = r"(?i)(€\s*)?(\d{1,3}(?:[.\s]\d{3})+(?:,\d{1,2})?|\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+,\d{1,2}|\d+\.\d{1,2}|\d+)(\s*(?:€|eur|euro))?"


#: The commonest forms of a value that is all there is after its label: read at once, with the results of the readers below.
PLAIN_TOKEN, PLAIN_MONEY = r"^[\s.\-–—]*[A-Za-z0-9]+\z", r"^[ :=]{0,4}(?:EUR )?\d{1,3}(?:\.\d{3})*,\d{2}\z"
PLAIN_DATE, PLAIN_VAT, PLAIN_IBAN = r"^[ :=]{0,4}\d{2}/\d{2}/[1-9]\d{3}\z", r"^[ :=]{0,4}\d{11}\z", r"^[ :=]{0,4}[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}\z"


def group(text: Column, pattern: str, n: int = 0) -> Column:
    """A group of the first match; null without match or with an empty group."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def position(text: Column, raw: Column) -> Column:
    """0-based index of the first occurrence; -1 without one."""
    return F.call_function("instr", text, raw) - 1


def real_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text of an existing day, else null."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def full_year(raw: Column) -> Column:
    short = F.when(raw.cast("int") <= PIVOT_YEAR, F.concat(F.lit("20"), raw)).otherwise(F.concat(F.lit("19"), raw))
    return F.when(F.length(raw) == 2, short).otherwise(raw)


def found_date(text: Column) -> Column:
    """struct<raw, value> of the first ISO date if it is real, else of the first d/m/y date if that is. Each pattern is sought once a text."""

    def real(raw: Column, order: tuple[int, int, int]) -> Column:
        def of(parts: Column) -> Column:
            year, month, day = (F.get(parts, F.lit(i)) for i in order)
            return let(real_date(full_year(year), month, day), lambda v: F.when(v.isNotNull(), F.struct(raw.alias("raw"), v.alias("value"))))

        return F.when(raw != "", let(F.split(raw, "[/.-]"), of))

    iso = let(F.regexp_extract(text, ISO, 0), lambda r: real(r, (0, 1, 2)))
    return F.coalesce(iso, let(F.regexp_extract(text, DMY, 0), lambda r: real(r, (2, 1, 0))))


def find_date(text: Column) -> Column:
    return found_date(text)["value"]


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("string")


def find_textual_date(text: Column) -> Column:
    return F.when(group(text, TEXTUAL).isNotNull(), real_date(group(text, TEXTUAL, 3), month_number(group(text, TEXTUAL, 2)), group(text, TEXTUAL, 1)))


def normalize_date(text: Column) -> Column:
    """ISO text of a value that is a date as a whole; also with spaces between the digits."""
    t = F.trim(text)
    spaced = r"^(\d{1,2})\s+(\d{1,2})\s+(\d{4}|\d{2})$"
    by_space = real_date(full_year(group(t, spaced, 3)), group(t, spaced, 2), group(t, spaced, 1))
    whole = F.when(group(t, TEXTUAL) == t, find_textual_date(t))
    numeric = F.when(found_date(t)["raw"] == t, found_date(t)["value"])
    return F.when(t.rlike(spaced), by_space).otherwise(F.coalesce(whole, numeric))


def read_date(text: Column, window: int = SAME_LINE_WINDOW) -> Column:
    numeric = let(found_date(text), lambda d: F.when(position(text, d["raw"]) <= window, d["value"]))
    textual = F.when(position(text, group(text, TEXTUAL)) <= window, find_textual_date(text))
    plain = F.concat_ws("-", F.substring(text, -4, 4), F.substring(text, -7, 2), F.substring(text, -10, 2)).try_cast("date").cast("string")
    return F.when(text.rlike(PLAIN_DATE), plain).otherwise(F.coalesce(numeric, textual))


def parse_money(raw: Column) -> Column:
    """Two-decimal text; the last separator is the decimal one iff one or two digits follow it."""

    def of(cleaned: Column) -> Column:
        def number(decimals: Column) -> Column:
            whole = F.regexp_replace(F.when(decimals != "", F.regexp_replace(cleaned, r"[.,]\d{1,2}$", "")).otherwise(cleaned), r"\D", "")
            return let(whole, lambda w: F.when(w != "", F.concat(w, F.lit("."), F.rpad(decimals, 2, "0"))).try_cast("decimal(30,2)").cast("string"))

        return let(F.regexp_extract(cleaned, r"[.,](\d{1,2})$", 1), number)

    return let(F.regexp_replace(F.regexp_replace(raw, r"[€\s]", ""), "(?i)euro?", ""), of)


def mask_dates(text: Column) -> Column:
    """The text with dates in digits blanked out by as many letters, so that they are no amounts."""
    masked = text
    for pattern, shapes in ((ISO, [10]), (DMY, [10, 9, 8, 7, 6])):
        for n in shapes:
            masked = F.regexp_replace(masked, pattern if len(shapes) == 1 else r"(?=.{%d}(?![A-Za-z0-9_]))" % n + DMY, "#" * n)
    return F.when(text.rlike(f"{ISO}|{DMY}"), masked).otherwise(text)


def found_money(text: Column) -> Column:
    """struct<raw, value> of the first amount with a currency, decimals or grouping; a minus counts if attached."""

    def first(masked: Column, matches: Column) -> Column:
        shaped = F.filter(
            F.transform(matches, lambda m, i: F.struct(m.alias("raw"), i.alias("i"))),
            lambda x: x["raw"].rlike(r"(?i)€|eur") | x["raw"].rlike(r"[.,]\d{1,2}$") | x["raw"].rlike(r"\d[.\s,]\d{3}"),
        )
        return let(F.get(shaped, F.lit(0)), lambda x: F.when(x.isNotNull(), signed(x["raw"], F.get(F.split(masked, MONEY, -1), x["i"]))))

    def signed(raw: Column, before: Column) -> Column:
        minus = before.rlike(r"(?:^|[\s:=])€?\s*[-−]$")
        value = let(parse_money(raw), lambda v: F.when(minus & (v.cast("decimal(30,2)") != 0), F.concat(F.lit("-"), v)).otherwise(v))
        return F.struct(F.trim(raw).alias("raw"), value.alias("value"))

    return let(mask_dates(text), lambda masked: let(F.regexp_extract_all(masked, F.lit(MONEY), 0), lambda found: first(masked, found)))


def read_money(text: Column, window: int = SAME_LINE_WINDOW) -> Column:
    plain = F.translate(text, ",:= EUR.", ".").try_cast("decimal(30,2)").cast("string")
    return F.when(text.rlike(PLAIN_MONEY), plain).otherwise(let(found_money(text), lambda m: F.when(position(text, m["raw"]) <= window, m["value"])))


def number_text(value: Column) -> Column:
    """Plain decimal text without trailing zeros."""
    text = value.cast("decimal(38,12)").cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def parse_decimal(raw: Column) -> Column:
    t = F.regexp_replace(raw, r"\s", "")
    commas, dots = F.length(t) - F.length(F.replace(t, F.lit(","))), F.length(t) - F.length(F.replace(t, F.lit(".")))
    comma_last = F.locate(",", F.reverse(t)) < F.locate(".", F.reverse(t))
    both = F.when(comma_last, F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(",")))
    one = F.when(commas > 1, F.replace(t, F.lit(","))).when(commas == 1, F.replace(t, F.lit(","), F.lit(".")))
    dotted = F.when((dots > 1) | t.rlike(r"^-?\d{1,3}\.\d{3}$"), F.replace(t, F.lit("."))).otherwise(t)
    cleaned = F.when((commas > 0) & (dots > 0), both).when(commas > 0, one).otherwise(dotted)
    return number_text(cleaned.try_cast("decimal(38,12)"))


NUMBER = r"-?\d+(?:[.,]\d+|\s\d{3}(?!\d))*"
INTEGER = r"(-?\d{1,3}(?:[.\s]\d{3})+|-?\d+)([.,]\d+)?"


def read_number(text: Column, window: int = SAME_LINE_WINDOW) -> Column:
    raw = group(text, NUMBER)
    return F.when(F.regexp_instr(text, F.lit(NUMBER)) - 1 <= window, parse_decimal(raw))


def read_integer(text: Column, window: int = SAME_LINE_WINDOW) -> Column:
    value = F.regexp_replace(group(text, INTEGER, 1), r"[.\s]", "").try_cast("long")
    ok = (F.regexp_instr(text, F.lit(INTEGER)) - 1 <= window) & group(text, INTEGER, 2).isNull() & (F.abs(value) <= 2**53 - 1)
    return F.when(ok, value.cast("string"))


def read_percentage(text: Column, window: int = SAME_LINE_WINDOW) -> Column:
    value = read_number(text, window)
    return F.when(value.try_cast("double").between(0, 100), value)


def read_currency(text: Column, allowed: list[str]) -> Column:
    token = group(F.regexp_replace(text, r"^[\s:=]+", ""), r"[\p{L}€$£]+")
    symbol = group(text, "[€$£]")
    names = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    raw = F.coalesce(token, symbol)
    code = F.coalesce(F.try_element_at(names, F.lower(raw)), F.try_element_at(names, symbol), F.upper(raw))
    return F.when(code.isin(allowed), code)


def read_boolean(text: Column) -> Column:
    t = F.regexp_replace(text, r"^[\s:=]+", "")
    return F.when(t.rlike("(?i)^(s[iì]|yes|true|vero)" + E), "true").when(t.rlike("(?i)^(no|false|falso)" + E), "false")


TAX_ID = "(?i)" + B + r"(?:(?:IT)?(\d{11})|([A-Z]{6}[\dLMNPQRSTUV]{2}[A-Z][\dLMNPQRSTUV]{2}[A-Z][\dLMNPQRSTUV]{3}[A-Z]))" + E
VAT = "(?i)" + B + r"(?:IT)?(\d{11})" + E
IBAN = B + r"([A-Za-z]{2}\d{2}(?:\s?[A-Za-z0-9]){11,30})" + E
REA = r"^(?:([A-Z]{2})\s*[-–]?\s*)?(\d{1,7})(?!\d|[/.,]\d)"
ANNOUNCED = r"(?i)^(?:n|nr|no|num|numero)" + E + r"\.?\s*[:°]?\s*"


#: Forms of tax codes, and of numbers that "n." or "prot." announces.
PERSONAL_CODE, BARE_VAT = r"(?i)" + B + r"([A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])" + E, B + r"(\d{11})" + E
OWN_NUMBER = r"(?i)" + B + r"(?:numero|nr\.?|n\.) ?[:°]? ?([A-Z0-9][A-Z0-9/_-]{0,30})"
PROTOCOL_NUMBER = r"(?i)" + B + r"(?:protocollo|prot\.) ?(?:n(?:umero)?\.?|nr\.?)? ?[:°]? ?([A-Z0-9][A-Z0-9/_-]{0,30})"
NOT_A_PROTOCOL = r"(?<!" + B + r"(?:protocollo|prot\.?) ?(?:n(?:umero)?\.?|nr\.?)? ?[:°]? ?)"


def find_tax_code(text: Column, bare_vat: bool) -> Column:
    """The first personal tax code of a text, in capitals; else, if wanted, the first eleven digits that stand alone."""
    code = F.upper(group(text, PERSONAL_CODE, 1))
    return F.coalesce(code, group(text, BARE_VAT, 1)) if bare_vat else code


def announced(text: Column, pattern: str) -> Column:
    """The first announced number that has a digit and is no date."""
    spaced = F.regexp_replace(text, r"\s+", " ")
    return F.get(F.filter(F.regexp_extract_all(spaced, F.lit(pattern), 1), lambda x: x.rlike(r"\d") & find_date(x).isNull()), F.lit(0))


def find_number(text: Column) -> Column:
    """A document's own number: one announced by "n.", "nr" or "numero" that isn't the protocol's."""
    return announced(text, "(?i)" + NOT_A_PROTOCOL + OWN_NUMBER)


def find_protocol(text: Column) -> Column:
    return announced(text, PROTOCOL_NUMBER)


def close(text: Column, pattern: str) -> Column:
    return F.regexp_instr(text, F.lit(pattern)).between(1, SAME_LINE_WINDOW + 1)


def read_tax_id(text: Column) -> Column:
    return F.when(close(text, TAX_ID), F.upper(F.coalesce(group(text, TAX_ID, 1), group(text, TAX_ID, 2))))


def read_vat(text: Column) -> Column:
    return F.when(text.rlike(PLAIN_VAT), F.substring(text, -11, 11)).when(close(text, VAT), group(text, VAT, 1))


def read_iban(text: Column) -> Column:
    return F.when(text.rlike(PLAIN_IBAN), F.upper(F.translate(text, ":= ", ""))).when(close(text, IBAN), F.upper(F.regexp_replace(group(text, IBAN, 1), r"\s", "")))


def read_rea(text: Column) -> Column:
    rest = F.regexp_replace(text, r"^[\s:=°#.\-–—]+", "")
    rest = F.when(rest.rlike(REA), rest).otherwise(F.regexp_replace(rest, ANNOUNCED, ""))
    return F.when(group(rest, REA, 1).isNotNull(), F.concat_ws(" - ", group(rest, REA, 1), group(rest, REA, 2))).otherwise(group(rest, REA, 2))


def read_code(text: Column, length: int) -> Column:
    pattern = B + r"([A-Za-z0-9]{%d})" % length + E
    code = group(text, pattern, 1)
    return F.when(close(text, pattern) & code.rlike(r"\d"), F.upper(code))


def read_token(text: Column) -> Column:
    """A token with a digit that is no date; one of one character only after a colon or "n."."""
    bare = F.regexp_replace(text, r"^[\s.\-–—]+", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[:=°#]+\s*", ""), ANNOUNCED, "")
    token = F.regexp_replace(group(rest, r"^[A-Za-z0-9][A-Za-z0-9/._-]*"), r"[._/-]+$", "")
    date = found_date(token)["raw"]
    plain = F.regexp_replace(text, r"^[\s.\-–—]+", "")
    return F.when(text.rlike(PLAIN_TOKEN), F.when(plain.rlike(r"\d") & (F.length(plain) >= 2), plain)).when(token.rlike(r"\d") & (date.isNull() | (date != token)) & ((F.length(token) >= 2) | (rest != bare)), token)


def read_identifier(text: Column, format: str | None) -> Column:
    if format in ("tax_id", "italian_tax_code"):
        return read_tax_id(text)
    if format == "vat_number":
        return read_vat(text)
    if format == "rea_number":
        return read_rea(text)
    if format in ("cig", "cup"):
        return read_code(text, 10 if format == "cig" else 15)
    if format == "iban":
        return read_iban(text)
    if format == "account_number":
        return F.coalesce(read_iban(text), read_token(text))
    return F.upper(read_token(text)) if format in ("vehicle_plate", "vin") else read_token(text)


def read_text(text: Column, same_line: bool) -> Column:
    if same_line:
        value = F.when(text.rlike(r"^\s*[:=]"), F.trim(F.regexp_replace(text, r"^\s*[:=]\s*", "")))
    else:
        t = F.trim(text)
        colon = F.instr(t, ":") - 1
        value = F.when((colon < 0) | (colon >= SAME_LINE_WINDOW), t)
    return F.when(~value.rlike(r"^[\\/]") & F.length(value).between(1, MOST_TEXT), value)


def read_value(text: Column, type_: str, format: str | None = None, scale: str | None = None, enum: list[str] | None = None, next_line: bool = False) -> Column:
    """The reader of a field's type and format."""
    window = NEXT_LINE_WINDOW if next_line else SAME_LINE_WINDOW
    if type_ == "identifier":
        return read_identifier(text, format)
    if format == "currency":
        return read_currency(text, enum or [])
    if type_ == "number":
        return read_percentage(text, window) if scale == "0_100" else read_number(text, window)
    readers = {"date": read_date, "money": read_money, "integer": read_integer}
    if type_ in readers:
        return readers[type_](text, window)
    return read_boolean(text) if type_ == "boolean" else read_text(text, not next_line)


def value_variants(value: Column) -> Column:
    """The ways in which a canonical value may be written: dates, decimals and IBANs have several."""
    day, month, year = F.substring(value, 9, 2), F.substring(value, 6, 2), F.substring(value, 1, 4)
    short = lambda x: F.regexp_replace(x, "^0", "")
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.least(F.greatest(month.try_cast("int"), F.lit(1)), F.lit(12)))
    dates = F.array(value, *[F.concat_ws(s, day, month, year) for s in "/.-"], *[F.concat_ws(s, short(day), short(month), year) for s in "/.-"], F.concat_ws(" ", short(day), name, year))
    grouped = F.translate(F.format_number(value.try_cast("decimal(30,2)"), 2), ",.", ".,")
    decimals = F.array(value, F.translate(value, ".", ","), grouped)
    compact = F.regexp_replace(value, r"\s", "")
    ibans = F.array(value, compact, F.trim(F.regexp_replace(compact, "(.{4})", "$1 ")))
    is_date = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    is_money = value.rlike(r"^-?\d+\.\d{2}$")
    is_iban = compact.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$")
    return F.array_distinct(F.when(is_date, dates).when(is_money, decimals).when(is_iban, ibans).otherwise(F.array(value)))


def fold_identifier(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""), r"^IT(?=\d{11}$)", ""), F.lit(""))


def add_years(date: Column, years: int) -> Column:
    """The same day so many years on; 29 February becomes the 28th."""
    return F.add_months(date, 12 * years)
