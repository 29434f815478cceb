"""Masks for personal data. Spark has no replace with a function: a text is split at the matches, the matches are
masked, and both are zipped together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from adjudica import settings as S
from adjudica.functions import text as X


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(F.lit(0), n).cast("int"))


def head(x: Column, n) -> Column:
    return F.substring(x, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def replace_each(x: Column, pattern: str, mask, groups: tuple[int, ...] = (0,)) -> Column:
    """``mask`` takes the groups of one match."""
    names = [f"g{g}" for g in groups]
    matches = F.arrays_zip(*[F.regexp_extract_all(x, F.lit(pattern), g).alias(n) for g, n in zip(groups, names, strict=True)])
    matches = F.transform(matches, lambda m: mask(*[m[n] for n in names]))
    parts = F.split(x, pattern, -1)
    masked = F.array_join(F.zip_with(parts, matches, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.when(x.rlike(pattern), masked).otherwise(x)


def mask_user(user: Column, domain: Column) -> Column:
    keep = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.length(user) / 2))).cast("int")
    return F.concat(head(user, keep), stars(F.length(user) - keep), F.lit("@"), domain)


def email(x: Column) -> Column:
    """A whole value: what stands around the address goes."""
    return F.when(x.rlike(S.MASK_EMAIL), mask_user(F.regexp_extract(x, S.MASK_EMAIL, 1), F.regexp_extract(x, S.MASK_EMAIL, 2))).otherwise(x)


def phone(x: Column) -> Column:
    own = X.digits(x)
    local = F.when(F.length(own) > 10, F.substring(own, -10, 10)).otherwise(own)
    n = F.length(local)
    return F.when(own == "", x).when(n <= 4, stars(n)).otherwise(F.concat(head(local, 2), stars(n - 4), F.substring(local, -2, 2)))


def mask_id(prefix: Column, sep: Column, value: Column) -> Column:
    n = F.length(value)
    short, long = F.concat(head(value, 1), stars(n - 1)), F.concat(head(value, 2), stars(n - 3), F.substring(value, -1, 1))
    return F.concat(prefix, F.coalesce(sep, F.lit("")), F.when(n <= 3, short).otherwise(long))


def ids(x: Column) -> Column:
    return replace_each(x, S.MASK_ID, mask_id, (1, 2, 3))


def name(x: Column) -> Column:
    """A whole value: one word keeps its initial, more keep the first word and the last one's initial."""
    words = F.split(X.collapse(x), " ")
    several = F.concat(F.get(words, 0), F.lit(" "), head(F.get(words, F.size(words) - 1), 1), F.lit("***"))
    return F.when(X.collapse(x) == "", x).when(F.size(words) < 2, F.concat(head(F.get(words, 0), 1), F.lit("***"))).otherwise(several)


def names(x: Column) -> Column:
    return F.regexp_replace(x, S.MASK_NAME, "$1 $2***")


def emails_in(x: Column) -> Column:
    return replace_each(x, S.MASK_EMAIL, mask_user, (1, 2))


def phones_in(x: Column) -> Column:
    return replace_each(x, S.MASK_PHONE, phone)


def text(x: Column) -> Column:
    """Addresses, then telephone numbers, then claim and policy ids, then names."""
    return names(ids(phones_in(emails_in(x))))


def nested(column: Column, kind: T.DataType, keep: tuple[str, ...] = ()) -> Column:
    """All strings of a nested value but those under a kept name; the recursion is over the type, at planning."""
    if isinstance(kind, T.StringType):
        return text(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: nested(x, kind.elementType, keep))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda k, v: F.when(k.isin(*keep), v).otherwise(nested(v, kind.valueType, keep)) if keep else nested(v, kind.valueType, keep))
    if isinstance(kind, T.StructType):
        made = F.struct(*[(column[f.name] if f.name in keep else nested(column[f.name], f.dataType, keep)).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), made)
    return column


def redact_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[(F.col(f"`{f.name}`") if f.name in keep else nested(F.col(f"`{f.name}`"), f.dataType, keep)).alias(f.name) for f in df.schema.fields])
