"""Scalar functions as column expressions; the few that expressions can't state are Arrow functions at the end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def slug(c: Column) -> Column:
    """Lower-case letters and digits, other runs as one `-`, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def snake(c: Column) -> Column:
    """`orderItem`, `OrderItem`, `order-item` to `order_item`; `HTTPServer` to `http_server`."""
    out = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    out = F.regexp_replace(out, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(out, r"[\s\-]+", "_"))


def pascal(c: Column) -> Column:
    return F.array_join(F.transform(F.split(snake(c), "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def camel(c: Column) -> Column:
    p = pascal(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))


def kebab(c: Column) -> Column:
    return F.regexp_replace(snake(c), "_", "-")


def plural(c: Column) -> Column:
    return (
        F.when(c.rlike("[^aeiou]y$"), F.regexp_replace(c, "y$", "ies"))
        .when(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es")))
        .otherwise(F.concat(c, F.lit("s")))
    )


def singular(c: Column) -> Column:
    return (
        F.when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y"))
        .when(c.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(c, "es$", ""))
        .when(c.rlike("[^s]s$"), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )


def truncate(c: Column, most: int) -> Column:
    """At most `most` characters, the last one an ellipsis if some were cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


def join_path(prefix: Column, path: Column) -> Column:
    """Both parts as one route: single slashes, one in front, none at the end, parameters as `{name}`."""
    parts = F.filter(F.split(F.concat_ws("/", prefix, path), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, parameter), "/"))


def parameter(segment: Column) -> Column:
    """`:id`, `<int:id>`, `<id>`, `{id:[0-9]+}`, `{id?}`, `[id]`, `*rest` and `$id` as `{id}`."""
    name = F.regexp_extract(segment, r"^(?::|\*|\$|<(?:[A-Za-z_]+:)?|\{\*?|\[(?:\.\.\.)?)([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.when(name != "", F.concat(F.lit("{"), name, F.lit("}"))).otherwise(segment)


def same_params(path: Column) -> Column:
    """A path for comparison: parameters as `{}`, no slash at the end."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(parameter(s).startswith("{"), F.lit("{}")).otherwise(s)), "/"))


def url_host(c: Column) -> Column:
    """The host of a URL without user and port; null if there is no `://`."""
    host = F.regexp_extract(c, r"://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.when(c.contains("://"), F.lower(host))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def placeholder_default(c: Column) -> Column:
    """`${VAR:-x}` and `${key:x}` replaced by their default, those without one by nothing."""
    return F.regexp_replace(F.regexp_replace(c, r"\$\{[^}:]*:-?([^}]*)\}", "$1"), r"\$\{[^}]*\}", "")


def first_sentence(c: Column) -> Column:
    return F.trim(F.regexp_extract(F.regexp_replace(c, r"\s+", " "), r"^(.*?[.!?])(?:\s|$)|^(.*)$", 0))


def fnv32(c: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-8 bytes, as a bigint from 0 to 2^32 - 1."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "$1,"), ","), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("bigint"))
    # 16777619 = 2^24 + 403: the product stays within a bigint
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)


def rfc3339(seconds: Column) -> Column:
    """Seconds since 1970 as `YYYY-MM-DDTHH:MM:SSZ`, whatever the session's time zone."""
    return F.date_format(F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def permalink(remote: Column, ref: Column, path: Column, start: Column, end: Column) -> Column:
    """A forge's URL of lines of a file from an https or ssh remote; null without a remote or ref."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(remote, r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/"), r"^https://[^/@]*@", "https://"), r"\.git/?$", "")
    lines = F.when(end > start, F.concat(F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))).otherwise(F.concat(F.lit("#L"), start.cast("string")))
    return F.when(base.startswith("https://"), F.concat(base, F.lit("/blob/"), ref, F.lit("/"), path, lines))


def markdown(c: Column) -> Column:
    """Text with Markdown's marks escaped."""
    return F.regexp_replace(c, r"([\\`*_{}\[\]<>#|])", r"\\$1")


def xml(c: Column) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def fnv64_hex(text: str) -> str:
    """FNV-1a of 64 bits over the UTF-8 bytes, as 16 hexadecimal digits."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv64(c: Column) -> Column:
    """FNV-1a of 64 bits as text: its products overflow a bigint, which ANSI mode refuses, so Arrow batches go to Python."""

    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else fnv64_hex(x))

    return F.pandas_udf(each, StringType())(c)
