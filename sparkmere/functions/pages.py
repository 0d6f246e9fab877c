"""Line classifiers of page texts: noise, page numbers, table-of-contents leaders and headings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the line classifiers.
NUMBERED = r"^(?:\d{1,2}(?:[.)．、]|\.\d{1,2})|[A-Z]\.)\s+\S+"
PAGE_NUMBER = r"^(?i:page\s*)?\d{1,3}$"
LEADER = r"\.{3,}\s*\d{1,3}$"
BROKEN = r"[\x{1}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]"
CJK = "[一-鿿]"
FOREIGN = ("manualslib.com", "the global manuals library", "other manualslib projects", "manuals / brands /", "quick links")


def squeezed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"(?U)\s+", " "))


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole)


def is_noise(line: Column) -> Column:
    """Empty lines, leaders, broken characters, foreign page furniture and rows of a table of contents, of a squeezed line."""
    low = F.lower(line)
    foreign = F.exists(F.array(*map(F.lit, FOREIGN)), lambda n: low.contains(n))
    readable = F.length(F.regexp_replace(line, r"(?U)[^\p{L}\p{N}\s.,:;!?()/\-&'’]", ""))
    garbled = line.rlike(BROKEN) | ((F.length(line) >= 12) & (_share(readable, F.length(line)) < 0.55))
    words = F.split(line, " ")
    digits = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", "").rlike(r"^\d+$")))
    short = F.size(F.filter(words, lambda w: F.length(w) <= 3))
    contents = (F.size(words) >= 4) & (digits >= 2) & (line.rlike(CJK) | (_share(short, F.size(words)) >= 0.35))
    return (line == "") | foreign | line.rlike(LEADER) | garbled | contents


def is_title_like(line: Column) -> Column:
    """Mostly capitals, or all words but one capitalised; no closing stop."""
    letters, upper = (F.length(F.regexp_replace(line, p, "")) for p in (r"\P{L}", r"\P{Lu}"))
    words = F.split(line, " ")
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (letters > 0) & ~line.rlike("[.,;]$") & ((_share(upper, letters) >= 0.6) | (titled >= F.greatest(F.lit(1), F.size(words) - 1)))


def line_kind(line: Column, hints: tuple[str, ...] = ()) -> Column:
    """noise, page_number, heading or text; hints are lower-case names of sections that make a heading."""

    def kind(line: Column) -> Column:
        low = F.regexp_replace(F.lower(line), "^[:-]+|[:-]+$", "")
        words = F.size(F.split(low, " "))
        named = low.isin(*hints) if hints else F.lit(False)
        holds = F.exists(F.array(*map(F.lit, hints)), lambda h: (F.length(h) >= 6) & low.contains(h)) if hints else F.lit(False)
        heading = (
            F.when(F.length(line) > 96, False).when(line.rlike(NUMBERED) | named, True).when(holds, (F.length(line) <= 72) & (words <= 6) & ~line.rlike("[.,;]$"))
            .when(line.rlike(CJK), (F.length(line) <= 18) & ~line.rlike("[。，；：]$")).otherwise(words.between(1, 6) & is_title_like(line))
        )
        return F.when(is_noise(line), "noise").when(line.rlike(PAGE_NUMBER), "page_number").when(heading, "heading").otherwise("text")

    return F.get(F.transform(F.array(squeezed(line)), kind), 0)
