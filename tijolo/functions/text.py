"""Column expressions that type listing and series text. All are built-in functions; what cannot be read is null."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?[0-9]*\.?[0-9]+$"
#: Month names of labels such as jan.-18, and the marks of a missing number.
MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
MISSING = ["", "...", "-", "null", "None"]
#: Words of an address that tell the kind of property, in order of precedence.
KINDS = [("Apartamento", ["apartamento"]), ("Casa", ["casa", "sobrado"]), ("Terreno", ["terreno", "lote"])]
OTHER = "Outro"


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


_DECOMPOSED = {c: _plain(c) for c in map(chr, range(0x80, sys.maxunicode + 1)) if _plain(c) != c and not unicodedata.combining(c) and not "\uac00" <= c <= "\ud7a3"}
#: Characters that are another single one once compatibility decomposition has taken their marks off, and those that are
#: several: ligatures, fractions, units, numbers in circles. Hangul syllables stay whole.
ACCENTED = "".join(c for c, p in _DECOMPOSED.items() if len(p) == 1)
PLAIN = "".join(_DECOMPOSED[c] for c in ACCENTED)
SEVERAL = {c: p for c, p in _DECOMPOSED.items() if len(p) != 1}
#: Marks that combine with the letter before them, as pairs of first and last.
_COMBINING = {c for c in range(0x80, sys.maxunicode + 1) if unicodedata.combining(chr(c))}
_RUNS = zip(sorted(c for c in _COMBINING if c - 1 not in _COMBINING), sorted(c for c in _COMBINING if c + 1 not in _COMBINING))
_MARKS = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _RUNS) + "]+"
#: Texts without these hold no mark, and no letter that stands for several; Java tests a range faster than a list of letters.
_RARE, _WIDE = r"[\x{bc}-\x{be}]|[^\x{0}-\x{131}]", r"[^\x{0}-\x{2ff}]"


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def classify_kind(address: Column) -> Column:
    low, out = F.lower(address), None
    for kind, words in KINDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(OTHER)


def extract_number(text: Column) -> Column:
    """First run of digits once points are dropped; `N/A` and blanks are null."""
    return F.when(F.trim(text) != "N/A", F.nullif(F.regexp_extract(F.replace(text, F.lit("."), F.lit("")), r"\d+", 0), F.lit("")).try_cast("double"))


def clean_price(text: Column) -> Column:
    """All digits before `Cond` and before `IPTU`, glued."""
    head = F.split_part(F.split_part(text, F.lit("Cond"), F.lit(1)), F.lit("IPTU"), F.lit(1))
    return F.nullif(F.regexp_replace(head, "[^0-9]", ""), F.lit("")).try_cast("double")


def parse_number(text: Column) -> Column:
    """Points are thousands where there is a comma, else decimal."""
    t = F.trim(text)
    comma = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(~t.isin(MISSING), _number(F.when(t.contains(","), comma).otherwise(t)))


def ptbr_number(text: Column) -> Column:
    """Point thousands, comma decimals; percent signs and blanks are dropped."""
    return _number(F.replace(F.replace(F.regexp_replace(text, "[%\\s]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def ptbr_month(label: Column) -> Column:
    """First day of a month label mmm.-yy of this century."""
    parts = F.split(F.trim(label), "-")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(parts[0], 1, 3)))
    good = (F.size(parts) == 2) & parts[1].rlike("^[0-9]{2}$") & (month > 0)
    return F.when(good, day_of(F.concat(F.lit("20"), F.get(parts, F.lit(1))), month.cast("string")))


def day_of(year: Column, month: Column, day: Column | None = None) -> Column:
    """The date of texts of digits, else null. A cast reads it without a formatter, whose failures cost an exception a row."""
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.lit("01") if day is None else day, 2, "0")).try_cast("date")


def brazilian_date(text: Column) -> Column:
    t = F.trim(text)
    # split_part would compile a pattern for every text
    year, month, day = F.substring_index(t, "/", -1), F.substring_index(F.substring_index(t, "/", 2), "/", -1), F.substring_index(t, "/", 1)
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), day_of(year, month, day))


def iso_date(text: Column) -> Column:
    """The day of an ISO text; zone marks are cut off without a shift."""
    t = F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", "")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?)?$"), F.substring(t, 1, 10).try_cast("date"))


def digits(code: Column) -> Column:
    return F.regexp_replace(code, "[^0-9]", "")


def period_frequency(code: Column) -> Column:
    return frequency_of_digits(digits(code))


def frequency_of_digits(code: Column) -> Column:
    n = F.length(code)
    return F.when(n == 8, "D").when(n == 5, "Q").when(n == 4, "A").otherwise("M")


def period_date(code: Column, six_digit_quarter: bool = False) -> Column:
    """Day, month, quarter or year code, of whose text only the digits count; years out of 1990-2035 and impossible dates are null."""
    return date_of_digits(digits(code), six_digit_quarter)


def date_of_digits(code: Column, six_digit_quarter: bool = False) -> Column:
    """`period_date` of a code's digits; each use of the code evaluates it, so it should be a column where there are many rows."""
    n, year, last = F.length(code), F.substring(code, 1, 4), F.substring(code, -1, 1)
    quarter = F.when(last == "2", "04").when(last == "3", "07").when(last == "4", "10").otherwise("01")
    month = F.when(n == 4, "01").when((n == 5) | ((n == 6) & F.lit(six_digit_quarter)), quarter).otherwise(F.substring(code, 5, 2))
    # one cast for all lengths; years of four digits are in the order of their texts
    fits = n.isin(4, 5, 6, 8) & year.between("1990", "2035")
    return F.when(fits, F.concat_ws("-", year, month, F.when(n == 8, F.substring(code, 7, 2)).otherwise("01"))).try_cast("date")


def fold_accents(text: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or marks of their own. Letters that stand for several, such
    as ligatures, become these; only texts that may hold one are taken apart."""
    letters = F.map_from_arrays(F.split(F.lit("".join(SEVERAL)), ""), F.split(F.lit("\n".join(SEVERAL.values())), "\n"))
    apart = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c < "\u00bc", c).otherwise(F.coalesce(F.try_element_at(letters, c), c))), "")
    without = F.translate(text, "".join(SEVERAL), "")
    whole = F.when(text.rlike(_RARE) & (F.length(without) < F.length(text)), apart).otherwise(text)
    return F.lower(F.when(text.rlike(_WIDE), F.regexp_replace(F.translate(whole, ACCENTED, PLAIN), _MARKS, "")).otherwise(F.translate(whole, ACCENTED, PLAIN)))


def matches_folded(text: Column, word: Column) -> Column:
    """Whether text holds word, case and accents aside, by collation: nothing is rewritten."""
    return F.collate(text, "UNICODE_CI_AI").contains(F.collate(word, "UNICODE_CI_AI"))


def is_missing(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | (text == "N/A")
