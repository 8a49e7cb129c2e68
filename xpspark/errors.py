"""Query errors by code: static (found when a query is compiled), dynamic and type errors (found when it runs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "http://www.w3.org/2005/xqt-errors"

#: Fixed codes and what they say.
CODES = {
    "XPST0001": "static context component undefined",
    "XPST0003": "grammar violation",
    "XPST0005": "static type is empty-sequence()",
    "XPST0008": "unresolved name",
    "XPST0010": "unsupported axis",
    "XPST0017": "no function of this name and arity",
    "XPST0051": "unknown atomic type",
    "XPST0080": "cast to an abstract type",
    "XPDY0002": "dynamic context component undefined",
    "XPDY0050": "treat as: value is of another type",
    "XPTY0004": "type mismatch",
    "XPTY0018": "path mixes nodes and values",
    "XPTY0019": "path step on a value",
    "XPTY0020": "context item is not a node",
    "FORG0001": "invalid value for cast",
    "FORG0003": "zero-or-one called with more items",
    "FOTY0012": "element has no typed value",
    "FODT0002": "duration overflow",
    "FOAR0001": "division by zero",
    "FOAY0001": "array index out of bounds",
    "FOAY0002": "negative array length",
    "FOCH0001": "invalid code point",
    "FOCH0003": "unknown normalization form",
    "FOJS0001": "invalid JSON",
    "FOJS0002": "value cannot be serialized",
    "FOCA0002": "invalid lexical QName",
    "FONS0004": "no namespace for prefix",
    "FORX0001": "invalid regular expression flags",
    "FORX0002": "invalid regular expression",
    "FORX0003": "pattern matches the empty string",
    "FORX0004": "invalid replacement string",
    "FODC0005": "invalid document address",
    "FOER0000": "error raised by the query",
    "XUST0003": "duplicate map keys",
}


class QueryError(Exception):
    """An error with a code; ``qname`` and ``uri`` name it as ``err:CODE``."""

    def __init__(self, code: str, message: str = ""):
        self.code = code
        super().__init__(f"{code}: {message or CODES.get(code, '')}")

    @property
    def qname(self) -> str:
        return f"err:{self.code}"

    @property
    def uri(self) -> str:
        return f"{NAMESPACE}#{self.code}"


class StaticError(QueryError):
    pass


class DynamicError(QueryError):
    pass


class TypeMismatch(QueryError):
    pass


def is_static(code: str) -> bool:
    return code.startswith("XPST")


def is_type(code: str) -> bool:
    return code.startswith(("XPTY", "FOTY"))


def describe(code: str) -> str:
    return f"{code}: {CODES[code]}" if code in CODES else code


def fail(code: str, message: str = "", kind: str = "string") -> Column:
    """An expression that raises when a row reaches it."""
    return F.raise_error(F.lit(f"{code}: {message or CODES.get(code, '')}")).cast(kind)
