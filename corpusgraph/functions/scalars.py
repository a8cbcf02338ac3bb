"""Formatting, colour and geometry as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def csv_field(x: Column) -> Column:
    return F.when(x.rlike('[",;\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def joined(terms: Column, count: int = 3) -> Column:
    """a, b y c; a dash for none."""
    t = F.slice(terms, 1, count)
    n = F.size(t)
    return F.when(n == 0, "—").when(n == 1, F.get(t, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" y "), F.element_at(t, -1)))


def rounded(x: Column, places: int) -> Column:
    """Half up on the double itself."""
    k = 10**places
    return F.floor(x * k + 0.5) / k


def byte_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return out


@F.pandas_udf(StringType())
def path_link(path: pd.Series) -> pd.Series:
    """A path for a Markdown link, percent-encoded."""
    from urllib.parse import quote

    return path.map(lambda p: None if p is None else quote(p, safe="/;,?:@&=+$-_.!~*'()#"))


def hue(i: Column) -> Column:
    """The colour wheel's angle of a community: the golden angle apart."""
    return (F.lit(258.0) + i * 137.508) % 360


def oklab_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """OKLab to sRGB from 0 to 255 (Ottosson 2020)."""
    # fixed values: the published matrices
    l, m, s = (F.pow(lightness + p * a + q * b, F.lit(3)) for p, q in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480)))
    rows = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))

    def channel(x: Column) -> Column:
        lit = F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), lit)) * 255 + 0.5)

    return tuple(channel(p * l + q * m + r * s) for p, q, r in rows)


def community_rgb(i: Column, lightness: float = 0.72, chroma: float = 0.13) -> tuple[Column, Column, Column]:
    angle = hue(i) * (math.pi / 180)
    return oklab_rgb(F.lit(lightness), chroma * F.cos(angle), chroma * F.sin(angle))


def radius(value: Column, largest: Column, low: float = 3.0, high: float = 18.0) -> Column:
    return low + (high - low) * F.sqrt(value / F.greatest(largest, F.lit(1)))


def projected(x: Column, y: Column, zoom: float, centre: tuple[float, float], screen: tuple[float, float]) -> tuple[Column, Column]:
    return (x - centre[0]) * zoom + screen[0] / 2, (y - centre[1]) * zoom + screen[1] / 2


def thousands(n: Column) -> Column:
    """A whole number with commas; null is 0."""
    return F.format_number(F.floor(F.coalesce(n, F.lit(0)) + F.lit(0.5)), 0)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(thousands(n), F.lit(" "), F.when(F.abs(n) == 1, one).otherwise(many or one + "s"))


def fixed(x: Column, places: int) -> Column:
    """So many decimals, rounded by the double's exact value."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def byte_text(n: Column) -> Column:
    """Bytes in steps of 1024, with one decimal under ten; null and 0 are 0 B."""
    out = F.concat(F.floor(n + 0.5).cast("string"), F.lit(" B"))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB")):
        v = n / 1024**power
        text = F.when(v < 10, fixed(v, 1)).otherwise(fixed(v, 0))
        out = F.when(n >= 1024**power, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").otherwise(out)


def duration(ms: Column) -> Column:
    """Milliseconds, seconds with two decimals under ten and else one, or minutes and seconds; a dash for null."""
    seconds = F.when(ms < 10_000, F.concat(fixed(ms / 1000, 2), F.lit(" s"))).otherwise(F.concat(fixed(ms / 1000, 1), F.lit(" s")))
    minutes = F.concat(F.floor(ms / 60_000).cast("string"), F.lit(" min "), F.floor((ms % 60_000) / 1000 + 0.5).cast("string"), F.lit(" s"))
    text = F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).when(ms < 60_000, seconds).otherwise(minutes)
    return F.when(ms.isNull(), "—").otherwise(text)


def date_text(ms: Column, months: tuple[str, ...]) -> Column:
    """Day, short month in the caller's language, year, hour and minute of a time in milliseconds; a dash for null and 0."""
    t = F.timestamp_millis(ms)
    month = F.element_at(F.array(*[F.lit(m) for m in months]), F.month(t))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "—").otherwise(F.concat(F.date_format(t, "dd "), month, F.date_format(t, " yyyy HH:mm")))
