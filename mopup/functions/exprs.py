"""Column-expression builders shared by every operator.

Everything here returns a ``pyspark.sql.Column`` built from JVM-side
functions, so the operators that use them stay inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

# --- fixed values: the characters Python's str.strip() removes (str.isspace()),
# as code points: stripping is a trim of this set at both ends (no regex, no scan
# of the whole text)
WHITESPACE_CODEPOINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE = "".join(chr(c) for c in WHITESPACE_CODEPOINTS)
# --- fixed values: a plain decimal number as the strict text-to-number parse accepts it.
NUMBER_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INT_RE = r"^[+-]?[0-9]+$"
EXACT_DOUBLE = 1 << 53  # every integer up to it has a DOUBLE of its own
THOUSANDS_DOT_RE = r"^-?\d{1,3}(\.\d{3})+(\.\d+)?$"
CURRENCY_WS_RE = r"(?U)[$€£₹,\s\x{1c}-\x{1f}]"

# --- fixed values: timestamp layouts tried in order (month first for slashes), each
# with the text shape it needs; the shape test keeps failing parses out of the parser
TIMESTAMP_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd HH:mm", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"),
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"),
    ("MM/dd/yyyy HH:mm:ss", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("dd-MMM-yyyy", r"^\d{2}-[A-Za-z]{3}-\d{4}$"),
]

# --- fixed values: English month abbreviations, in calendar order (dd-MMM-yyyy)
MONTH_ABBREVIATIONS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
               "october", "november", "december"]


def sql_str(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_col(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_in(values) -> str:
    return ", ".join(sql_str(v) for v in values)


_SQL_WS = None


def strip_sql(name: str) -> str:
    global _SQL_WS
    if _SQL_WS is None:
        _SQL_WS = sql_str(WHITESPACE)
    return f"btrim({sql_col(name)}, {_SQL_WS})"


def placeholder_expr(name: str, kind: str) -> Column:
    """The placeholder predicate of a named column as one SQL expression (parsed once
    in the JVM; the IN list becomes a hash-set lookup).  ``kind`` is one of clean,
    analyze, outlier (text columns, null → null) or score (any type, null → true)."""
    if kind == "score":
        raise ValueError("use score_placeholder_expr for the scoring vocabulary")
    vocab = {"clean": tokens.PH_CLEAN, "analyze": tokens.PH_ANALYZE, "outlier": tokens.PH_OUTLIER}[kind]
    s = strip_sql(name)
    return F.expr(f"({s} IN ({_sql_in(vocab)}) OR startswith({s}, '###'))")


def score_placeholder_expr(name: str, dt) -> Column:
    """Scoring vocabulary of a named column as one SQL expression.  Only text is
    compared with the words: a number's text can only hit the list as +infinity
    ("inf" / "infinity"; NaN is null by then), and timestamps, dates and booleans
    never do, so those test null (and +infinity) without printing the value."""
    x = sql_col(name)
    if dt is not True and not (dt is not False and is_text(dt)):
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            return F.expr(f"({x} IS NULL OR {x} = double('+inf'))")
        if dt is False or isinstance(dt, (T.NumericType, T.BooleanType, T.TimestampType,
                                          T.TimestampNTZType, T.DateType)):
            return F.expr(f"({x} IS NULL)")
        t = f"CAST({x} AS STRING)"
    else:
        t = x
    global _SQL_WS
    if _SQL_WS is None:
        _SQL_WS = sql_str(WHITESPACE)
    s = f"lower(btrim({t}, {_SQL_WS}))"
    return F.expr(f"coalesce({x} IS NULL OR {s} IN ({_sql_in(tokens.PH_SCORE)}) OR {s} RLIKE '^#+$', true)")


def _stripped(name: str, stripped: bool) -> Column:
    return F.expr(sql_col(name) if stripped else strip_sql(name))


def number_expr(name: str, stripped: bool = False) -> Column:
    """``parse_number`` of a named column."""
    return parse_number(_stripped(name, stripped), stripped=True)


def int_expr(name: str, stripped: bool = False) -> Column:
    """``parse_int`` of a named column."""
    return parse_int(_stripped(name, stripped), stripped=True)


def timestamp_expr(name: str, stripped: bool = False, layouts=None) -> Column:
    """``parse_timestamp`` of a named column."""
    return parse_timestamp(_stripped(name, stripped), stripped=True, layouts=layouts)


def bool_expr(name: str) -> Column:
    x = sql_col(name)
    return F.expr(f"CASE WHEN {x} IN ({_sql_in(tokens.BOOL_TRUE)}) THEN true "
                  f"WHEN {x} IN ({_sql_in(tokens.BOOL_FALSE)}) THEN false END")


_LIT_CACHE: dict = {}


def lits(values: list) -> list[Column]:
    """Literal Columns for a fixed vocabulary, built once per Spark context and
    reused (each literal is otherwise a separate driver→JVM call)."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    k = (id(sc), tuple(values))
    got = _LIT_CACHE.get(k)
    if got is None:
        got = [F.lit(v) for v in values]
        _LIT_CACHE[k] = got
    return got


_COL_CACHE: dict = {}


def col(name: str) -> Column:
    """Column reference that tolerates dots, spaces and colons in names.  An
    unresolved reference is immutable, so one object per name and session is
    reused (each new one costs a driver→JVM round trip)."""
    from pyspark import SparkContext
    k = (id(SparkContext._active_spark_context), name)
    c = _COL_CACHE.get(k)
    if c is None:
        c = F.col("`" + name.replace("`", "``") + "`")
        _COL_CACHE[k] = c
    return c


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_orderable(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.MapType, T.ArrayType, T.StructType, T.BinaryType))


def strip_ws(c: Column) -> Column:
    """Unicode whitespace strip, like Python's ``str.strip()``: a set trim at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def as_text(c: Column, dt: T.DataType) -> Column:
    return c if is_text(dt) else c.cast("string")


def null_if(c: Column, pred: Column) -> Column:
    return F.when(pred, F.lit(None)).otherwise(c)


def nan_to_null(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c)
    return c


def parse_number(c: Column, stripped: bool = False) -> Column:
    """Strict text → DOUBLE: only plain decimal text parses; anything else is null."""
    s = c if stripped else strip_ws(c)
    return F.when(s.rlike(NUMBER_RE), s.try_cast("double"))


def parse_int(c: Column, stripped: bool = False) -> Column:
    """Strict text → BIGINT (null when not an integer literal or out of range)."""
    s = c if stripped else strip_ws(c)
    return F.when(s.rlike(INT_RE), s.try_cast("bigint"))


def date_like(c: Column) -> Column:
    return c.contains("-") | c.contains("/") | c.contains(":")


# A date, then perhaps a time with seconds, fractions, AM/PM and a zone offset.
_DATE_RES = {
    "ymd": r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})",
    "mdy": r"(\d{1,2})/(\d{1,2})/(\d{4})",
    "Mdy": r"([A-Za-z]{3,9})\.? +(\d{1,2}),? +(\d{4})",
    "dMy": r"(\d{1,2})[- ]([A-Za-z]{3,9})\.?,?[- ](\d{4})",
}
_TIME_RE = (r"(?:(?:[T ]|, ) *(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,9})?)?(?: *([AaPp][Mm]))?"
            r"(?: *(?:[Zz]|(?:UTC|GMT)?([+-]\d{2}):?(\d{2})?|UTC|GMT))?)?")

#: Every layout and the shape of its texts.  A text is read by the first layout whose shape it has.
LAYOUTS = [*TIMESTAMP_FORMATS, *[(kind, f"^{date}{_TIME_RE}$") for kind, date in _DATE_RES.items()]]
# most texts have none of the shapes: one cheap test spares them the others
_ROUGH_DATE = r"^[0-9A-Za-z]{1,9}[-/. ]"


def layout_of(s: Column) -> Column:
    """The number of the layout of a stripped text, null where it has none."""
    out = F.when(~s.rlike(_ROUGH_DATE), F.lit(None).cast("int"))
    for i, (_, shape) in enumerate(LAYOUTS):
        out = out.when(s.rlike(shape), F.lit(i))
    return out


def parse_timestamp(c: Column, stripped: bool = False, layouts=None) -> Column:
    """Text → TIMESTAMP_NTZ by its layout; failures are null.  ``layouts`` are the numbers of those
    that the column is known to have (``layout_of``): only they are tried.

    Beside the fixed layouts these are dates without leading zeros, with month names, fractions of a second, AM
    or PM, or a zone offset; a time with an offset becomes that of UTC.  Slashes read month first."""
    s = c if stripped else strip_ws(c)
    out = None
    for i in range(len(LAYOUTS)) if layouts is None else sorted(layouts):
        name, shape = LAYOUTS[i]
        value = _loose_timestamp(s, name) if name in _DATE_RES else _iso_text(s, name).try_cast("timestamp_ntz")
        out = F.when(s.rlike(shape), value) if out is None else out.when(s.rlike(shape), value)
    if out is None:
        return F.lit(None).cast("timestamp_ntz")
    return out if layouts is not None else F.when(s.rlike(_ROUGH_DATE), out)


def _iso_text(s: Column, fmt: str) -> Column:
    """A text of a fixed layout as ISO text, which is read without a time zone: the wall-clock text becomes
    the timestamp as written."""
    if fmt.startswith("MM/dd/yyyy"):
        return F.regexp_replace(s, r"^(\d{2})/(\d{2})/(\d{4})", "$3-$1-$2")
    if fmt == "yyyy/MM/dd":
        return F.regexp_replace(s, "/", "-")
    if fmt == "dd-MMM-yyyy":
        month = F.array_position(F.array(*lits(MONTH_ABBREVIATIONS)), F.lower(F.substring(s, 4, 3)))
        return F.concat(F.substring(s, 8, 4), F.lit("-"), F.when(month > 0, month.cast("string")), F.lit("-"),
                        F.substring(s, 1, 2))
    return s


#: Places of year, month and day among the parts of each layout.
_ISO_ORDER = {"ymd": "$1-$2-$3", "mdy": "$3-$1-$2", "Mdy": "$3-#-$2", "dMy": "$3-#-$1"}


def _loose_timestamp(s: Column, kind: str) -> Column:
    """A text of one of the layouts in ``_DATE_RES``: one replacement puts its parts in ISO order."""
    whole = f"^{_DATE_RES[kind]}{_TIME_RE}$"
    iso = F.regexp_replace(s, whole, _ISO_ORDER[kind] + "T$4:$5:$6$7")
    if "M" in kind:
        name = F.lower(F.regexp_extract(s, "[A-Za-z]{3,9}", 0))
        at = F.array_position(F.array(*lits(MONTH_ABBREVIATIONS)), F.substring(name, 1, 3))
        iso = F.replace(iso, F.lit("#"), F.when((at > 0) & ((F.length(name) == 3) | name.isin(*lits(MONTH_NAMES))), at.cast("string")))
    # a part that is missing is empty: no seconds, or no time at all
    wall = F.rtrim(iso, F.lit("T:")).try_cast("timestamp_ntz")
    # few texts have AM, PM or a zone after the time
    hour, half = F.regexp_extract(s, whole, 4).try_cast("int"), F.lower(F.regexp_extract(s, whole, 8))
    shift_h, shift_m = F.regexp_extract(s, whole, 9), F.regexp_extract(s, whole, 10)
    hours = F.when(half == "", 0).when((hour < 1) | (hour > 12), F.lit(None)).otherwise(
        F.when(half == "pm", 12).otherwise(0) - F.when(hour == 12, 12).otherwise(0))
    minutes = F.when(shift_h == "", 0).otherwise(
        shift_h.try_cast("int") * 60
        + F.when(F.startswith(shift_h, F.lit("-")), -1).otherwise(1) * F.coalesce(shift_m.try_cast("int"), F.lit(0)))
    moved = wall + F.make_dt_interval(F.lit(0), hours, -minutes)
    return F.when(s.rlike(r":\d\d.*[A-Za-z+-]"), moved).otherwise(wall)


def to_bool(c: Column, dt: T.DataType) -> Column:
    if is_text(dt):
        return (F.when(c.isin(*lits(tokens.BOOL_TRUE)), F.lit(True))
                .when(c.isin(*lits(tokens.BOOL_FALSE)), F.lit(False)))
    if isinstance(dt, T.BooleanType):
        return c
    if is_numeric(dt):
        return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
    return F.lit(None).cast("boolean")


def coerce_numeric_like(c: Column, dt: T.DataType, stripped: bool = False) -> Column:
    """Lenient number parse used by the score: drops currency signs, commas and
    whitespace, and treats dot-grouped thousands (1.234.567) as grouping."""
    s = F.lower(c if stripped else strip_ws(as_text(c, dt)))
    s = F.regexp_replace(s, CURRENCY_WS_RE, "")
    s = F.when(s.rlike(THOUSANDS_DOT_RE), F.regexp_replace(s, r"\.", "")).otherwise(s)
    return F.when(s.rlike(NUMBER_RE), s.try_cast("double"))


def balanced(exprs: list[Column], op) -> Column:
    """Combine many per-column expressions as a balanced tree (depth log2 n), so
    that a table with hundreds of columns does not build an expression hundreds of
    levels deep."""
    xs = list(exprs)
    while len(xs) > 1:
        xs = [op(xs[i], xs[i + 1]) if i + 1 < len(xs) else xs[i] for i in range(0, len(xs), 2)]
    return xs[0]


def sum_all(exprs: list[Column]) -> Column:
    return balanced(exprs, lambda a, b: a + b) if exprs else F.lit(0)


def any_of(exprs: list[Column]) -> Column:
    return balanced(exprs, lambda a, b: a | b) if exprs else F.lit(False)


def all_of(exprs: list[Column]) -> Column:
    return balanced(exprs, lambda a, b: a & b) if exprs else F.lit(True)


def normalize_name(name: str) -> str:
    """Column-name normalisation: the stripped name in lower case, with an underscore in place of each
    blank and of each character that ASCII lacks."""
    return re.sub(r"[ \u0080-\U0010ffff]", "_", f"{name}".strip().lower())
