"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns whose matches must agree with the published semantics.
PRICE = r"(?i)(?:Price:\s*|\|\s*\$)(\d+(?:\.\d+)?)"
SELECTED = r"(?is)Selected:\s*\{(.*?)\}"


def _foldings() -> dict[str, str]:
    """What full case folding makes of the characters that lower case alone does not do, by Python's tables."""
    every = (chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c.lower()}


FOLDINGS = _foldings()


def folded(text: Column) -> Column:
    """Case folding: lower case, then sharp s, final sigma, ligatures and the like as one form. Text of ASCII characters alone is only lowered."""
    one = {c: f for c, f in FOLDINGS.items() if len(f) == 1}
    several = {c: f for c, f in FOLDINGS.items() if len(f) > 1}
    low = F.lower(text)
    out = low
    for c, f in several.items():
        out = F.replace(out, F.lit(c), F.lit(f))
    out = F.when(low.rlike("[" + "".join(several) + "]"), out).otherwise(low)
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(out, "".join(one), "".join(one.values()))).otherwise(low)


def folded_sql(text: str) -> str:
    """The same in DuckDB's dialect."""
    one = {c: f for c, f in FOLDINGS.items() if len(f) == 1}
    text = f"lower({text})"
    for c, f in FOLDINGS.items():
        text = f"replace({text}, '{c}', '{f.replace(chr(39), chr(39) * 2)}')" if len(f) > 1 else text
    return f"translate({text}, '{''.join(one)}', '{''.join(one.values())}')"


def normalise(text: Column, *, fold: bool = False) -> Column:
    """Lower case (or case folding), outer blanks off, inner white space to one blank. Logs' commands are ASCII, for which both are the same."""
    return F.trim(F.regexp_replace(folded(text) if fold else F.lower(text), r"\s+", " "))


def without_number(entity: Column) -> Column:
    """An entity without its trailing instance number."""
    return F.regexp_replace(normalise(entity), r"\s+\d+$", "")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def phrase_visible(phrase: Column, text: Column) -> Column:
    """Whether the phrase has terms and all of them are among the text's."""
    p = terms(phrase)
    return (F.size(p) > 0) & (F.size(F.array_except(p, terms(text))) == 0)


def prices(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PRICE), F.lit(1)), lambda x: x.cast("double"))


def selected_count(text: Column) -> Column:
    """Colons inside the first ``Selected: {...}``."""
    inside = F.regexp_extract(text, SELECTED, 1)
    return F.length(inside) - F.length(F.replace(inside, F.lit(":"), F.lit("")))


def first_line(text: Column) -> Column:
    return F.coalesce(F.substring_index(text, "\n", 1), F.lit(""))


#: Command forms of the household domain, in order: two things and the verb they are written with, a tool and
#: two things, one thing.
PICK_UP = r"^(?:take|pick)\s+(.+?)\s+from\s+(.+?)$"
PUT = r"^(?:put|move)\s+(.+?)\s+(?:to|in/on|in|on)\s+(.+?)$"
WITH_TOOL = r"^(clean|heat|cool|slice)\s+(.+?)\s+with\s+(.+?)$"
UNARY = r"^(go to|open|close|use|toggle|examine)\s+(.+?)$"
BARE = ("inventory", "look", "help")


def action_signature(command: Column) -> Column:
    """Canonical call text of a household command by the first form that it has, else upper case without numbers."""
    a = normalise(command)
    group = lambda p, i: F.regexp_extract(a, p, i)
    call = lambda verb, *things: F.concat(verb, F.lit("("), F.concat_ws(", ", *[without_number(t) for t in things]), F.lit(")"))
    verb = lambda p: F.upper(F.replace(group(p, 1), F.lit(" "), F.lit("_")))
    forms = {
        PICK_UP: call(F.lit("PICK_UP"), group(PICK_UP, 1), group(PICK_UP, 2)), PUT: call(F.lit("PUT"), group(PUT, 1), group(PUT, 2)),
        WITH_TOOL: call(verb(WITH_TOOL), group(WITH_TOOL, 2), group(WITH_TOOL, 3)), UNARY: call(verb(UNARY), group(UNARY, 2)),
    }
    out = F.upper(F.regexp_replace(a, r"\s+\d+\b", ""))
    for pattern, text in reversed(forms.items()):
        out = F.when(a.rlike(pattern), text).otherwise(out)
    return F.when(a.isin(*BARE), F.upper(a)).otherwise(out)


def content_id(prefix: str, parts: Column, length: int = 12) -> Column:
    """Prefix and the first hex digits of the SHA-256 of the parts joined by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(parts, "\x1f"), 256), 1, length))


def tagged(text: Column, tag: str) -> Column:
    """The text between ``<tag>`` and ``</tag>``, without outer blanks."""
    return F.trim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1))
