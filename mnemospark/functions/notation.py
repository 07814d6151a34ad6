"""Column builders that read the notations lists, ids and type names are written in.

All are Catalyst expressions.  A null or blank value, ``null`` and unreadable
JSON give an empty list; elements that are null or blank are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that surrounds keys: blanks, tabs and line ends.
_EDGES = r"^[\s ]+|[\s ]+$"


def strip(c: Column | str) -> Column:
    """Without surrounding white space; null stays null."""
    return F.regexp_replace(c, _EDGES, "")


def key(c: Column | str) -> Column:
    """An identifier as it is compared: stripped and in lower case; blank becomes null."""
    k = F.lower(strip(c))
    return F.when(k != "", k)


def elements(c: Column | str, field: str, wrapper: str | None = None) -> Column:
    """The elements of a list as raw strings.

    Read are JSON lists of strings (single or double quotes), JSON lists of
    objects whose ``field`` counts, an object whose ``wrapper`` holds such a list,
    and plain values separated by commas.
    """
    s = strip(c)
    first = F.substring(s, 1, 1)
    text = s
    if wrapper:
        text = F.when(first == "{", F.get_json_object(s, f"$.{wrapper}")).otherwise(s)
    listed = F.from_json(text, "array<string>")
    of_objects = F.from_json(text, f"array<struct<{field}:string>>")
    plain = F.split(s, ",", -1)
    # a list of objects has "{" right after its bracket
    objects = text.rlike(r"^\[\s*\{")
    values = (
        F.when(s.isNull() | (s == "") | (F.lower(s) == "null"), F.array().cast("array<string>"))
        .when(objects, F.transform(of_objects, lambda x: x[field]))
        .when(first.isin("[", "{"), listed)
        .otherwise(plain)
    )
    return F.coalesce(values, F.array().cast("array<string>"))


def tags(c: Column | str) -> Column:
    """Distinct tags in code point order: stripped, lower case, without a leading ``#``."""
    clean = F.transform(
        elements(c, "tag", "tags"),
        lambda x: strip(F.regexp_replace(F.lower(strip(x)), "^#", "")),
    )
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def ids(c: Column | str) -> Column:
    """Distinct identifiers of a list, as ``key`` writes them."""
    return F.array_distinct(F.filter(F.transform(elements(c, "id", "ids"), key), lambda x: x.isNotNull()))


def edge_types(c: Column | str) -> Column:
    """Distinct relation names of an edge_type in any notation, as ``lower_snake``.

    Plain names in any letter case with blanks, dashes or underscores, names behind
    ``EdgeType.``, JSON lists of names, and objects whose ``relation`` counts.
    """
    s = strip(c)
    first = F.substring(s, 1, 1)
    names = (
        F.when(s.isNull() | (s == "") | (F.lower(s) == "null"), F.array().cast("array<string>"))
        .when(first == "{", F.array(F.coalesce(*[F.get_json_object(s, f"$.{k}") for k in ("relation", "type", "name")])))
        .when(first == "[", F.from_json(s, "array<string>"))
        .otherwise(F.array(s))
    )
    snake = lambda x: F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"^edgetype\.", ""), r"[\s\-]+", "_")
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), snake), lambda x: x.isNotNull() & (x != "")))


#: The numeric codes of the lifecycle states, in code order.
STATE_CODES = ("active", "rehearsing", "consolidating", "dormant", "ghost", "reactivated")


def state(c: Column | str) -> Column:
    """A lifecycle state in any notation as its lower-case name; null when blank or unreadable.

    Plain names in any letter case, names behind ``MemoryState.``, objects whose
    ``name`` counts, one-element lists and the numeric codes.
    """
    s = strip(c)
    first = F.substring(s, 1, 1)
    inner = (
        F.when(first == "{", F.coalesce(*[F.get_json_object(s, f"$.{k}") for k in ("name", "state", "value")]))
        .when(first == "[", F.element_at(F.from_json(s, "array<string>"), -1))
        .otherwise(s)
    )
    name = F.regexp_replace(F.lower(strip(inner)), r"^memorystate\.", "")
    code = F.try_element_at(F.array(*map(F.lit, STATE_CODES)), F.when(name.rlike(r"^\d$"), name.cast("int") + 1))
    out = F.when(name.rlike(r"^\d$"), code).otherwise(name)
    return F.when(out.isin(*STATE_CODES), out)
