"""Row-level functions: codes, names, addresses, dates, sizes and derived source attributes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from tilewright import vocab as V


def _ascii_part(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


# letter -> its ASCII letters by compatibility decomposition: one letter each, and those that give several or lie above U+FFFF
_PARTS = {chr(c): _ascii_part(chr(c)) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and _ascii_part(chr(c))}
_FOLD = {c: a for c, a in _PARTS.items() if len(a) == 1 and c < "\U00010000"}
_EXPAND = {c: a for c, a in _PARTS.items() if c not in _FOLD}


def _class_of(letters) -> str:
    """A character class in as few ranges as possible: a pattern tries one after the other."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


_EXPANDED = _class_of(_EXPAND)
# a wider class that is quick to try: all that lies above Latin-1, and those below
_MAYBE_EXPANDED = _class_of([c for c in _EXPAND if c < "\u0100"])[:-1] + "\\x{100}-\\x{10ffff}]"


def epsg_code(numeric: Column, code: Column) -> Column:
    """`proj:epsg` when set and not zero, else the number in an `EPSG:n` code."""
    from_code = F.nullif(F.regexp_extract(F.upper(code), r"^EPSG:(\d+)", 1), F.lit("")).cast("int")
    return F.coalesce(F.nullif(numeric, F.lit(0)), from_code)


def grid_bbox(transform: Column, rows: Column, cols: Column) -> Column:
    """Bounds of a raster from its six affine terms and its shape."""
    a, b, c, d, e, f = (F.get(transform, F.lit(i)) for i in range(6))
    xs = [c, c + a * cols, c + b * rows, c + a * cols + b * rows]
    ys = [f, f + d * cols, f + e * rows, f + d * cols + e * rows]
    return F.when(F.size(transform) >= 6, F.struct(F.least(*xs).alias("minx"), F.least(*ys).alias("miny"),
                                                  F.greatest(*xs).alias("maxx"), F.greatest(*ys).alias("maxy")))


def composite_key(*parts: Column) -> Column:
    """Parts joined by '/', null as soon as one is missing."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws("/", *[p.cast("string") for p in parts]))


def group_from_id(item_id: Column, pattern: Column) -> Column:
    """First group of a per-source pattern searched in the item id."""
    return F.nullif(F.call_function("regexp_extract", item_id, pattern, F.lit(1)), F.lit(""))


def resolve_aliases(alias: Column, assets: Column) -> Column:
    """Canonical name -> asset, taking the first provider key that is present; absent names are left out."""
    pairs = F.transform(F.map_entries(alias), lambda e: F.struct(
        e["key"].alias("key"),
        F.get(F.filter(e["value"], lambda k: F.map_contains_key(assets, k)), F.lit(0)).alias("provider")))
    found = F.filter(pairs, lambda e: e["provider"].isNotNull())
    return F.map_from_entries(F.transform(found, lambda e: F.struct(e["key"], F.try_element_at(assets, e["provider"]))))


def composite_time(dt: Column, start: Column, end: Column) -> Column:
    """Middle of the interval when both ends are given, else the instant, else the start."""
    middle = F.timestamp_micros(F.expr("0L") + F.call_function("div", F.unix_micros(start) + F.unix_micros(end), F.lit(2)))
    return F.coalesce(F.when(start.isNotNull() & end.isNotNull(), middle), dt, start)


def safe_name(s: Column) -> Column:
    """A name that is valid on every file system."""
    return F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[ .]+$", "")


def cache_name(url: Column) -> Column:
    """Host and path of an address flattened into one file name."""
    host = F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return safe_name(F.replace(F.concat(host, path), F.lit("/"), F.lit("__")))


def slug(text: Column) -> Column:
    """ASCII-folded lower-case words joined by '-'."""
    several = F.create_map(*[F.lit(x) for kv in _EXPAND.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    rare = F.rlike(text, F.lit(_MAYBE_EXPANDED)) & F.rlike(text, F.lit(_EXPANDED))
    folded = F.when(F.rlike(text, F.lit(r"[^\x00-\x7f]")), F.translate(F.when(rare, spelled).otherwise(text), "".join(_FOLD), "".join(_FOLD.values()))).otherwise(text)
    ascii_only = F.regexp_replace(folded, r"[^\x00-\x7f]", "")
    dashed = F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("project"))


def redact(text: Column) -> Column:
    """Addresses in free text lose their query strings, which may carry credentials."""
    return F.regexp_replace(text, r"(https?://[^\s'\"?]+)\?[^\s'\"]*", "$1?…")


def href_class(href: Column) -> Column:
    """blob (needs signing), protected (needs a login), or plain."""
    host = F.lower(F.regexp_extract(href, r"^https://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(href, r"^https://[^/?#]*([^?#]*)", 1)
    suffix = F.lit(False)
    for s in V.PROTECTED_SUFFIXES:
        suffix = suffix | host.endswith(s)
    return (F.when(href.contains(V.BLOB_SUFFIX), "blob")
            .when(suffix & path.contains("protected"), "protected").otherwise("plain"))


def size_text(n: Column) -> Column:
    return F.when(n >= V.GB_FROM_BYTES, F.format_string("%.2f GB", n / 1e9)).otherwise(F.format_string("%.0f MB", n / 1e6))


def megabytes(n: Column) -> Column:
    return F.format_string("%,.1f MB", n / 1e6)


def partial_date(v: Column) -> Column:
    """Full date, year-month or year; null for anything else (such as 'live')."""
    return F.when(F.substring(v, 1, 4).rlike("^[0-9]{4}$"), F.coalesce(
        F.try_to_date(F.when(F.length(v) >= 10, F.substring(v, 1, 10)), "yyyy-MM-dd"),
        F.try_to_date(F.when(F.length(v) >= 7, F.substring(v, 1, 7)), "yyyy-MM"),
        F.try_to_date(F.substring(v, 1, 4), "yyyy")))


def windowed_bytes(size: Column, fraction: Column) -> Column:
    """Bytes expected for a partial read; null when the size is unknown."""
    return F.floor(size * fraction).cast("bigint") + F.lit(V.WINDOW_OVERHEAD_BYTES).cast("bigint")


def share_of(total: Column, part: Column, whole: Column) -> Column:
    """floor(total * part / whole) of byte counts and file counts; the product is exact, whatever its size."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = wide(total) * wide(part)
    rest = F.pmod(product, wide(whole))
    return ((product - rest) / wide(whole)).cast("bigint")


def nodata_value(dtype: Column, declared: Column, override: Column) -> Column:
    extreme = F.create_map(*[F.lit(x) for kv in V.DTYPE_NODATA.items() for x in kv])
    return F.coalesce(declared, override, F.try_element_at(extreme, dtype), F.lit(-9999.0))


def planner(shape: Column, driver: Column, explicit: Column, cloud_dependent: Column, themes: Column, group_by: Column) -> Column:
    return F.when((shape == "series") & (driver == "stac"), F.coalesce(
        explicit,
        F.when(cloud_dependent, "optical")
        .when(F.array_contains(themes, "sar") & F.coalesce(group_by == F.array(F.lit("sat:relative_orbit")), F.lit(False)), "sar")
        .otherwise("products")))


def yearly(revisit_days: Column) -> Column:
    return F.coalesce(revisit_days, F.lit(0)) >= V.YEARLY_REVISIT_DAYS


def chosen_assets(themes: Column, theme_assets: Column, default_assets: Column, all_assets: Column) -> Column:
    """Assets for a list of themes: the theme's own list, else the defaults, else everything; first use wins."""
    return F.array_distinct(F.flatten(F.transform(themes, lambda t: F.coalesce(
        F.try_element_at(theme_assets, t), default_assets, all_assets))))


def window_step(temporal: Column, source_yearly: Column, start: Column, end: Column) -> Column:
    return (F.when(temporal == "pair", "pair")
            .when(source_yearly | (F.datediff(end, start) > V.LONG_PERIOD_DAYS), "yearly").otherwise("monthly"))


def multihash(content: Column) -> Column:
    """Self-describing SHA-256 checksum of a file's bytes."""
    return F.concat(F.lit("1220"), F.sha2(content, 256))


def transient(error: Column) -> Column:
    hit = F.lit(False)
    for t in V.TRANSIENT_ERRORS:
        hit = hit | error.contains(t)
    return hit


def year_runs(years: Column) -> Column:
    """Sorted distinct years -> '2005–2007, 2024–2025' (the array form of the islands operator)."""
    ys = F.array_sort(F.array_distinct(years))
    ends = F.filter(ys, lambda y: ~F.array_contains(ys, y + 1))
    starts = F.filter(ys, lambda y: ~F.array_contains(ys, y - 1))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(
        F.concat(a.cast("string"), F.lit("–"), b.cast("string")))), ", ")
