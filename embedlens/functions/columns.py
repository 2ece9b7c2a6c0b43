"""Column functions: vectors, text, hashes and stable math. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column | str) -> Column:
    """A vector with double components; sums over float32 lose digits."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once for a row, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def l2_normalize(v: Column) -> Column:
    """v / max(|v|, 1e-12); the norm is taken once a vector."""
    return bound(v, lambda w: bound(F.greatest(norm(w), F.lit(EPS)), lambda n: F.transform(w, lambda x: x / n)))


def dims(v: Column, start: int, n: int) -> Column:
    """Components start .. start + n - 1, from 1."""
    return F.slice(v, start, n)


def blank_leading(v: Column, fraction: float) -> Column:
    """Leading round(n * fraction) components set to zero, then normalised."""
    cut = F.round(F.size(v) * F.lit(fraction)).cast("int")
    return l2_normalize(F.transform(v, lambda x, i: F.when(i < cut, F.lit(0.0)).otherwise(x)))


def drop_leading(text: Column, fraction: float) -> Column:
    """The text without its leading round(n * fraction) characters."""
    return F.substring(text, F.round(F.length(text) * F.lit(fraction)).cast("int") + 1, F.length(text))


def hash60(seed: str, *parts: Column) -> Column:
    """60-bit md5 prefix of ``seed:part:part...`` as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def slugify(text: Column, width: int = 32, default: str = "run") -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, width), F.lit("")), F.lit(default))


def item_title(title: Column) -> Column:
    return F.replace(F.coalesce(title, F.lit("")), F.lit("_"), F.lit(" "))


def item_body(title: Column, snippet: Column, limit: int = 2000) -> Column:
    return F.substring(F.concat(item_title(title), F.lit("\n"), F.coalesce(snippet, F.lit(""))), 1, limit)


def title_or_untitled(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled"))


def blob_path(idx: Column, kind: str = "blobs", suffix: str = "png") -> Column:
    return F.format_string(f"{kind}/%02d/%07d.{suffix}", F.floor(idx / 1000).cast("long"), idx)


def warmup_cosine(step: Column, warmup: int, steps: int) -> Column:
    """Learning-rate factor of a step: linear warm-up, then half a cosine."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(max(1, steps - warmup))))
    return F.when(step < warmup, (step + 1) / F.lit(max(1, warmup))).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * p)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def text_ratio(chunk: Column) -> Column:
    """Share of characters that are not white space."""
    return F.length(F.regexp_replace(chunk, "[ \\t\\n\\r\\x0b\\f]", "")) / F.length(chunk)
