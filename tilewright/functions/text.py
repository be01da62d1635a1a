"""Where and when of a question, as column expressions over its whole text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from tilewright import vocab as V
from tilewright.functions.bind import let
from tilewright.sources.registry_rows import RULES

# The accepted wordings of months, years and ranges.
MONTH = (r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
         r"|nov(?:ember)?|dec(?:ember)?)")
YEAR = r"((?:19|20)[0-9]{2})"
TO = r"\s*(?:to|until|till|through|thru|-|–|—)\s*"
ISO = r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}"
NUMBER = r"([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten|twelve)"
PERIOD_PATTERNS = {
    "month year to month year": rf"{MONTH}\s+{YEAR}{TO}{MONTH}\s+{YEAR}",
    "month to month year": rf"{MONTH}{TO}{MONTH},?\s+{YEAR}",
    "month year": rf"{MONTH},?\s+{YEAR}",
    "year to year": rf"(?:between\s+)?{YEAR}(?:{TO}|\s+and\s+){YEAR}",
    "monsoon of year": rf"(?:{YEAR}\s+monsoon|monsoon\s+(?:of\s+)?{YEAR})",
    "since year": rf"since\s+{YEAR}",
    "last n": rf"(?:last|past|previous)\s+{NUMBER}\s+(years?|months?)",
    "monsoon": r"monsoon",
    "month": MONTH,
    "year": YEAR,
}
PERIOD_TYPE = "struct<start:date,end:date,text:string,event:date>"
NAME = r"[A-Z][\p{L}\p{N}_'’.-]*"
PLACE_PATTERN = rf"({NAME}(?:\s+(?:{NAME}|{'|'.join(V.NAME_LINKS)}))*(?:\s+(?:{'|'.join(V.ADMIN_WORDS)}))?)"
LOWER_NAME = r"[a-z][\p{L}\p{N}_'’.-]*"
LOWER_PATTERN = rf"(?:{'|'.join(V.LOWERCASE_PREPOSITIONS)})\s+({LOWER_NAME}(?:\s+{LOWER_NAME}){{0,4}})"
_OPEN, _CLOSE = "\u0001", "\u0002"


_MOST_DAYS = 700_000


def _whole(p: str) -> str:
    return rf"(?U)\b{p}\b"


def _month(word: Column) -> Column:
    return ((F.instr(F.lit("".join(m[:3] for m in V.MONTH_NAMES)), F.substring(word, 1, 3)) + 2) / 3).cast("int")


def parse_period(text: Column, today: dt.date) -> Column:
    """Period named in a text: the first wording that matches decides, from most to least specific; null without any.

    A pattern is searched once; its parts are taken from the few words it matched.
    """
    now = F.lit(today)
    day = lambda y, m, d: F.make_date(y, m if isinstance(m, Column) else F.lit(m), F.lit(d))
    period = lambda s, e, t, ev=None: F.struct(s.alias("start"), e.alias("end"), t.alias("text"), (F.lit(None).cast("date") if ev is None else ev).alias("event")).cast(PERIOD_TYPE)
    part = lambda name, m, i: F.regexp_extract(m, _whole(PERIOD_PATTERNS[name]), i)
    year = lambda name, m, i: part(name, m, i).cast("int")
    month_end = lambda y, m: F.last_day(day(y, m, 1))

    def of_month_years(m):
        n = "month year to month year"
        return period(day(year(n, m, 2), _month(part(n, m, 1)), 1), month_end(year(n, m, 4), _month(part(n, m, 3))), m)

    def of_months(m):
        n = "month to month year"
        return period(day(year(n, m, 3), _month(part(n, m, 1)), 1), month_end(year(n, m, 3), _month(part(n, m, 2))), m)

    def of_month_year(m):
        n = "month year"
        return period(day(year(n, m, 2), _month(part(n, m, 1)), 1), month_end(year(n, m, 2), _month(part(n, m, 1))), m)

    def of_years(m):
        a, b = year("year to year", m, 1), year("year to year", m, 2)
        return period(day(F.least(a, b), 1, 1), F.least(day(F.greatest(a, b), 12, 31), now), m)

    def of_monsoon_year(m):
        y = F.regexp_extract(m, YEAR, 1).cast("int")
        return period(day(y, 6, 1), F.least(day(y, 9, 30), now), m)

    def of_since(m):
        return period(day(year("since year", m, 1), 1, 1), now, m)

    def of_last(m):
        word = part("last n", m, 1)
        spelled = F.create_map(*[F.lit(x) for kv in V.NUMBER_WORDS.items() for x in kv])
        n = F.coalesce(F.try_element_at(spelled, word).cast("bigint"), word.try_cast("bigint"))
        days = F.try_multiply(n, F.when(part("last n", m, 2).startswith("year"), F.lit(365)).otherwise(30).cast("bigint"))
        # a number that leads before the calendar names no period
        return F.when(days < _MOST_DAYS, period(F.date_sub(now, F.least(days, F.lit(_MOST_DAYS)).cast("int")), now, m))

    def of_monsoon(m):
        y = F.lit(today.year if today >= dt.date(today.year, 6, 1) else today.year - 1)
        return period(day(y, 6, 1), F.least(day(y, 9, 30), now), m)

    def of_month(m):
        k = _month(m)
        y = F.when(k <= today.month, today.year).otherwise(today.year - 1)
        return period(day(y, k, 1), F.least(month_end(y, k), now), m)

    def of_year(m):
        y = m.cast("int")
        return period(day(y, 1, 1), F.least(day(y, 12, 31), now), m)

    builders = (of_month_years, of_months, of_month_year, of_years, of_monsoon_year, of_since, of_last, of_monsoon, of_month, of_year)

    def ladder(t: Column, steps: list) -> Column:
        if not steps:
            return F.lit(None).cast(PERIOD_TYPE)
        (name, build), rest = steps[0], steps[1:]
        return let(F.regexp_extract(t, _whole(PERIOD_PATTERNS[name]), 0), lambda m: F.when(m != "", build(m)).otherwise(ladder(t, rest)))

    def dated(t: Column) -> Column:
        iso = F.slice(F.regexp_extract_all(t, F.lit(_whole(ISO)), F.lit(0)), 1, 2)

        def of_iso(found):
            a, b = (F.try_to_date(F.get(found, F.lit(i)), "yyyy-MM-dd") for i in (0, 1))
            both = F.concat(F.get(found, F.lit(0)), F.lit(" … "), F.get(found, F.lit(1)))
            return (F.when(a.isNotNull() & b.isNotNull(), period(F.least(a, b), F.greatest(a, b), both))
                    .when(a.isNotNull() & (F.size(found) == 1), period(F.date_sub(a, 30), F.date_add(a, 30), F.get(found, F.lit(0)), a))
                    .otherwise(ladder(t, list(zip(PERIOD_PATTERNS, builders)))))

        return let(iso, of_iso)

    return let(F.lower(text), dated)


def stop_words(rules: list[dict] = RULES) -> list[str]:
    """Words that never start a place: lead words, months and the plain words of rule keywords."""
    import re
    words = set(V.LEAD_WORDS) | set(V.MONTH_WORDS)
    for r in rules:
        for k in r["keywords"]:
            words |= set(re.findall(r"[a-z]{3,}", k.replace("\\b", " ").lower()))
    return sorted(words)


def without_period(text: Column, period_text: Column) -> Column:
    """Text with the words of its period blanked, case ignored."""
    quoted = F.concat(F.lit("(?iu)"), F.lit("\\Q"), period_text, F.lit("\\E"))
    return F.when(period_text.isNull(), text).otherwise(F.call_function("regexp_replace", text, quoted, F.lit(" ")))


def place_candidates(text: Column, period_text: Column, stop: list[str]) -> Column:
    """Places named in a text, likeliest first: after a preposition, then others, then the first word of a sentence.

    Runs of capitalised words are found; where none is left, words typed in lower case after a preposition.
    """
    return let(without_period(text, period_text), lambda t: let(_capitalised(t, stop), lambda found: F.when(
        F.size(found) > 0, found).otherwise(_lowercase(t, stop))))


def _trimmed(words: Column, stop: list[str]) -> Column:
    lead = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(".,")).isin(*stop))
    kept = let(F.array_position(lead, F.lit(False)).cast("int"), lambda i: F.when(i > 0, F.slice(words, i, F.size(words))).otherwise(F.array().cast("array<string>")))

    def tail(ws):
        back = F.reverse(F.transform(ws, lambda w: F.lower(w).isin(*V.NAME_LINKS)))
        return let(F.array_position(back, F.lit(False)).cast("int"), lambda i: F.when(i > 0, F.slice(ws, F.lit(1), F.size(ws) - i + 1)).otherwise(F.array().cast("array<string>")))

    return F.btrim(F.array_join(let(kept, tail), " "), F.lit(" .,"))


def _capitalised(t: Column, stop: list[str]) -> Column:
    marked = F.regexp_replace(t, r"(?U)\b" + PLACE_PATTERN, f"{_OPEN}$1{_CLOSE}")

    def of_parts(parts):
        def one(i):
            name = F.substring_index(F.get(parts, i), _CLOSE, 1)
            before = F.rtrim(F.regexp_replace(F.get(parts, i - 1), r"(?U)\x02|\s+$", ""))
            prev = F.lower(F.regexp_extract(before, r"(?U)(\S+)$", 1))
            rank = F.when(prev.isin(*V.PREPOSITIONS), 0).when((before == "") | F.right(before, F.lit(1)).isin(".", "!", "?"), 2).otherwise(1)
            return F.struct(rank.alias("rank"), i.alias("i"), _trimmed(F.split(name, r"(?U)\s+"), stop).alias("name"))

        found = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), one)).otherwise(F.array().cast("array<struct<rank:int,i:int,name:string>>"))
        good = F.filter(found, lambda c: (c["name"] != "") & ~F.lower(c["name"]).isin(*stop))
        return let(good, first_of_each)

    def first_of_each(good):
        names = F.transform(good, lambda c: c["name"])
        return let(names, lambda ns: F.transform(F.array_sort(F.transform(F.array_distinct(ns), lambda n: F.get(good, F.array_position(ns, n).cast("int") - 1))), lambda c: c["name"]))

    return let(F.split(marked, _OPEN), of_parts)


def _title(s: Column) -> Column:
    """Capital after every non-letter."""
    return F.array_join(F.transform(F.split(s, r"(?<=[^\p{L}])(?=\p{L})"), lambda p: F.initcap(p)), "")


def _lowercase(t: Column, stop: list[str]) -> Column:
    runs = F.regexp_extract_all(t, F.lit(r"(?iU)\b" + LOWER_PATTERN), F.lit(1))

    def name_of(run):
        def cut(words):
            plain = F.transform(words, lambda w: F.lower(w))
            admin = F.transform(plain, lambda w, i: (i > 0) & w.isin(*V.ADMIN_WORDS))
            ends = F.transform(plain, lambda w, i: ~((i > 0) & w.isin(*V.ADMIN_WORDS)) & (w.isin(*V.END_WORDS) | w.isin(*stop) | w.rlike("^(19|20)[0-9]{2}$")))
            first = lambda flags, extra: let(F.array_position(flags, F.lit(True)).cast("int"), lambda i: F.when(i > 0, i + extra).otherwise(F.size(words)))
            return F.slice(words, F.lit(1), F.least(first(admin, 0), first(ends, -1)))

        bare = F.transform(F.split(run, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(".,;:!?")))
        return F.array_join(let(bare, cut), " ")

    names = F.filter(F.transform(runs, name_of), lambda n: (n != "") & ~F.lower(n).isin(*stop))

    def distinct(ns):
        lows = F.transform(ns, lambda n: F.lower(n))
        return let(lows, lambda ls: F.filter(ns, lambda n, i: F.array_position(ls, F.get(ls, i)) == i + 1))

    return F.transform(let(names, distinct), lambda n: F.when(n == F.lower(n), _title(n)).otherwise(n))


def mask_places(text: Column, places: Column) -> Column:
    """Text with every place replaced by 'the area', for ranking by meaning only."""
    return F.aggregate(places, text, lambda t, p: F.replace(t, p, F.lit("the area")))
