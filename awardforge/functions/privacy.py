"""What may leave the house: titles that name a person are withheld whole, free-text columns are dropped.

A title is read as words and marks, and each rule looks at a few of them from one place on: an introduction (role, mark, name), an office
that puts surnames into its titles (office, mark, name), or two names before such an office.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Free-text columns that no public table carries; roles, office codes, and words after an office that are no names.
PUBLIC_EXCLUDED = {"fact_contract_awards": ("description_raw", "classification_reason"), "fact_transactions": ("description",)}
WITHHELD = "[Title withheld - it names a point of contact; see source record]"
CONTACT_ROLES = ("POC", "TPOC", "ATTN")
OFFICER_ROLES = ("CO", "CS", "COR")
OFFICES = ("PHK", "CMK")  # besides PK and one of OFFICE_CLASSES, with or without one more letter
OFFICE_CLASSES = ("A", "F", "H", "S", "P")
NO_NAMES = ("DCC", "WING", "IACP", "MFRC", "RISK", "SYSTEM", "SYSTEMS", "AAS", "CISO", "CONGRESSIONAL", "DTA", "ISSO", "PZ")
NO_LEADING_NAMES = ("IGF", "PROJECT", "LABOR")

MARKS = (":", "/", ";", ",", "-")
_TOKEN = r"[A-Z0-9'.]+|[^A-Z0-9'.\s]"


def tokens(title: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(title, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def _word(t: Column) -> Column:
    return F.substr(t, F.lit(1), F.lit(1)).between("A", "Z")


def _name(t: Column) -> Column:
    """A word that may be a surname: neither a known other word nor a fiscal year."""
    bare = F.substring_index(F.substring_index(t, ".", 1), "'", 1)
    return _word(t) & ~bare.isin(*NO_NAMES) & ~bare.rlike("^FY[0-9]+$")


def _office(t: Column) -> Column:
    coded = F.substr(t, F.lit(1), F.lit(2)) == "PK"
    return t.isin(*OFFICES) | (coded & F.length(t).between(3, 4) & F.substr(t, F.lit(3), F.lit(1)).isin(*OFFICE_CLASSES) & F.substr(F.concat(t, F.lit("A")), F.lit(4), F.lit(1)).between("A", "Z"))


def _named_at(seen: str, i: Column) -> Column:
    """Whether a person is named from place ``i`` of the array column ``seen`` on."""
    at = lambda k: F.coalesce(F.get(F.col(seen), i + k), F.lit(""))
    after = lambda k: F.coalesce(F.get(F.filter(F.slice(F.col(seen), i + k + 1, 6), lambda t: ~t.isin(*MARKS)), 0), F.lit(""))
    told = lambda k: at(k).isin(":", "-")
    one = at(0)
    contact = one.isin(*CONTACT_ROLES) & (told(1) | ((at(1) == ")") & told(2)))
    contact = contact | (one.isin(*CONTACT_ROLES[:2]) & at(1).isin("FOR", "IS"))
    contact = contact | ((one == "ATT") & ((at(1) == ":") | ((at(1) == ")") & (at(2) == ":"))))
    contact = contact | ((one == "POINT") & (at(1) == "OF") & (at(2) == "CONTACT") & (told(3) | ((at(3) == "(") & (at(5) == ")") & told(6))))
    officer = one.isin(*OFFICER_ROLES) & (at(1) == ":") & _word(at(2))
    officer = officer | ((one == "COR") & (at(1) == "TO"))
    titled = ((one == "CONTRACTING") & at(1).startswith("OFFICER")) | ((one == "CONTRACT") & at(1).startswith("SPECIALIST"))
    officer = officer | (titled & (((at(2) == ":") & _word(at(3))) | ((at(2) == "REPRESENTATIVE") & (at(3) == ":") & _word(at(4)))))
    office = (_office(one) & _name(after(1))) | ((one == "/") & (at(1) == "PK") & _name(after(2))) | ((one == "PK") & (at(1) == ":") & _name(at(2)))
    office = office | ((one == "PKB") & (at(1) == "-") & _word(at(2)) & (at(3) == "-") & _word(at(4)))
    office = office | (F.substr(one, F.lit(1), F.lit(4)) == "N102") & F.substr(F.concat(one, F.lit("A")), F.lit(5), F.lit(1)).between("A", "Z") & (F.length(one) <= 5)
    before = _word(one) & at(1).isin("-", "/") & _word(at(2)) & at(3).isin("-", "/") & _office(at(4))
    return contact | officer | office | before


def withhold_titles(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df`` with every title that names a person replaced whole. A null or empty title names nobody."""
    for c in (c for c in columns if c in df.columns):
        seen, head = f"_{c}_tokens", F.get(F.split(F.upper(F.coalesce(F.col(c), F.lit(""))), r"\s", 2), 0)
        # two names joined by a colon that open a title, as in no known tag
        pair = head.rlike("^[A-Z][A-Z'.]*:[A-Z][A-Z'.]*$") & ~F.substring_index(head, ":", 1).isin(*NO_LEADING_NAMES) & (F.length(F.trim(F.col(c))) > F.length(head))
        read = df.withColumn(seen, tokens(F.col(c)))
        places = F.sequence(F.lit(0), F.size(seen) - 1)
        named = F.when(F.size(seen) > 0, F.exists(places, _at_place(seen))).otherwise(False)
        df = read.withColumn(c, F.when(named | F.coalesce(pair, F.lit(False)), WITHHELD).otherwise(F.col(c))).drop(seen)
    return df


def _at_place(seen: str):
    return lambda i: _named_at(seen, i)


def public_columns(name: str, df: DataFrame) -> DataFrame:
    """A table as it may be published: without the free text that can carry names."""
    return df.drop(*PUBLIC_EXCLUDED.get(name, ()))
