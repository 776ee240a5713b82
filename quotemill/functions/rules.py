"""Scalar rules of the cleaning layer as native column expressions."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as null, and the texts of booleans.
NULL_WORDS = ("", "nan", "none", "null", "<na>")
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")
RUN_TOKENS = ("yyyy-MM-dd'T'HH-mm-ss", "yyyy-MM-dd'T'HHmmss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
DAY_FIRST = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x, places: int) -> Column:
    """Rounded as an exact decimal, half away from zero, then a double again.  Doubles that such a decimal cannot hold are whole numbers (or infinite)
    and stay; NaN is null."""
    value = _c(x).cast("double")
    return F.coalesce(F.round(_c(x).try_cast("decimal(28,10)"), places).cast("double"), F.nanvl(value, F.lit(None).cast("double")))


def compact(x) -> Column:
    """White space collapsed and trimmed; null words become null."""
    t = F.trim(F.regexp_replace(_c(x), r"\s+", " "))
    return F.when(~F.lower(t).isin(*NULL_WORDS), t)


def upper_or(x, default: str | None = None) -> Column:
    t = F.upper(compact(x))
    return t if default is None else F.coalesce(t, F.lit(default))


def lower_or(x, default: str | None = None) -> Column:
    t = F.lower(compact(x))
    return t if default is None else F.coalesce(t, F.lit(default))


def to_bool(x, default: bool | None = None) -> Column:
    """Known words by meaning, any other text true, null the default."""
    t = F.lower(F.trim(_c(x).cast("string")))
    return F.when(t.isNull() | t.isin(*NULL_WORDS), F.lit(default).cast("boolean")).when(t.isin(*FALSE_WORDS), False).otherwise(True)


def to_number(x, kind: str = "double") -> Column:
    return F.trim(_c(x).cast("string")).try_cast(kind)


def to_day(x, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy")) -> Column:
    """The first format that fits the whole text."""
    t = F.trim(_c(x).cast("string"))
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in formats)).cast("date")


def to_day_first(x) -> Column:
    return to_day(x, DAY_FIRST)


def run_token(x) -> Column:
    """A run or snapshot name as a timestamp; an offset is taken into account, bad names are null."""
    t = F.trim(_c(x).cast("string"))
    zoned = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}T\d{2})-(\d{2})-(\d{2})([+-]\d{2}:?\d{2}|Z)$", "$1:$2:$3$4")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in RUN_TOKENS), F.when(zoned.rlike(r"T\d{2}:\d{2}:\d{2}([+-]\d{2}:?\d{2}|Z)$"), F.try_to_timestamp(zoned)))


def epoch_or_text(x) -> Column:
    """Numbers are milliseconds beyond 10**10 and seconds up to it; anything else is parsed as a time."""
    t = F.trim(_c(x).cast("string"))
    n = t.try_cast("double")
    seconds = F.when(F.abs(n) > 1e10, n / 1000).otherwise(n)
    return F.when(n.isNotNull(), F.timestamp_micros(F.round(seconds * 1e6).cast("long"))).otherwise(F.try_to_timestamp(t))


def to_texts(x) -> Column:
    """A JSON list, or one value, as an array of trimmed non-empty strings."""
    t = F.trim(_c(x).cast("string"))
    items = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t))
    return F.when(F.lower(t).isin(*NULL_WORDS) | t.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.coalesce(items, F.array(t)), lambda s: F.trim(s)), lambda s: s != ""))


def to_json_text(x) -> Column:
    """Valid JSON stays, other text becomes {"raw": text}, null words become null."""
    t = F.trim(_c(x).cast("string"))
    return F.when(t.isNull() | F.lower(t).isin(*NULL_WORDS), F.lit(None).cast("string")).when(F.try_parse_json(t).isNotNull(), t).otherwise(F.to_json(F.struct(t.alias("raw"))))


@F.arrow_udf(T.StringType())
def _nfc(x: pa.Array) -> pa.Array:
    parts = (x.slice(i, 256).to_pylist() for i in range(0, len(x), 256))  # few texts as Python objects at a time
    return pa.concat_arrays([pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in part], pa.string()) for part in parts] or [pa.array([], pa.string())])


def nfc(x) -> Column:
    """Unicode NFC; plain ASCII never leaves the JVM."""
    c = _c(x)
    ascii_ = F.octet_length(c) == F.length(c)
    return F.when(ascii_, c).otherwise(_nfc(F.when(~ascii_, c)))  # the function gets every row, so null for the plain ones


def canonical_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns renamed without regard to case and spaces; per target the first alias at hand wins and the other aliases go."""
    clean = {"".join(c.lower().split()): c for c in reversed(df.columns)}
    chosen, dropped = {}, set()
    for target, names in aliases.items():
        have = [clean[n] for n in names if n in clean]
        if have:
            chosen[have[0]] = target
            dropped.update(have[1:])
    return df.select(*(F.col(f"`{c}`").alias(chosen.get(c, "".join(c.lower().split()))) for c in df.columns if c not in dropped))


def first_column(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first of the named columns that exists, whatever it holds; else null."""
    return next((df[n] for n in names if n in df.columns), F.lit(None).cast(kind))


def flattened(df: DataFrame) -> DataFrame:
    """Fields of structs as columns a_b."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}_{g}") for g in f.dataType.fieldNames()]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def normal_url(url) -> Column:
    """Scheme and host in lower case, default ports, fragments, ``utm_*`` and final slashes off, parameters sorted."""
    u = F.trim(_c(url))
    scheme, host, path, args = (F.try_parse_url(u, F.lit(x)) for x in ("PROTOCOL", "HOST", "PATH", "QUERY"))
    port = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    default = (F.lower(scheme) == "https") & (port == "443") | (F.lower(scheme) == "http") & (port == "80")
    at = F.when((port != "") & ~default, F.concat(F.lit(":"), port)).otherwise("")
    kept = F.array_sort(F.filter(F.split(F.coalesce(args, F.lit("")), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise("")
    return F.when(scheme.isNull() | host.isNull(), u).otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(host), at, F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), tail))
