"""Chunkers as Spark columns: paragraphs and sentences packed up to a size, overlaps, and tables cut between rows under their header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sentence and overlap boundaries.
SENTENCE = r"(?<=[。！？.!?])\s+|(?<=[。！？])"
TAIL_BOUNDARIES = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ")
TEXTS = "array<string>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_spaces(text: Column) -> Column:
    """Without the spaces (Unicode's Zs) at both ends; line ends and tabs stay."""
    return F.regexp_replace(text, r"\A\p{Zs}+|\p{Zs}+\z", "")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _none() -> Column:
    return F.array().cast(TEXTS)


def _stripped(parts: Column, trim=strip) -> Column:
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def _fold(items: Column, step) -> Column:
    """Parts that step (parts, current, item) -> (parts, current) leaves, with the last current one."""
    start = F.struct(_none().alias("parts"), F.lit("").alias("current"))

    def one(s: Column, x: Column) -> Column:
        parts, current = step(s["parts"], s["current"], x)
        return F.struct(parts.alias("parts"), current.alias("current"))

    return F.aggregate(items, start, one, lambda s: _stripped(F.concat(s["parts"], F.array(s["current"]))))


def hard_pieces(text: Column, size: int, trim=strip) -> Column:
    """Pieces of size characters, trimmed; a text that fits stays as it is."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(_stripped(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), trim))


def packed_paragraphs(text: Column, size: int) -> Column:
    """Paragraphs joined by blank lines while they fit; a paragraph that doesn't fit stands alone, uncut."""
    paragraphs = _stripped(F.split(text, r"\n\s*\n"))

    def step(parts, current, x):
        fits = F.length(current) + F.length(x) + 2 <= size
        return F.when((current == "") | fits, parts).otherwise(F.array_append(parts, current)), F.when(current == "", x).when(fits, F.concat(current, F.lit("\n\n"), x)).otherwise(x)

    return _fold(paragraphs, step)


def sentences(text: Column) -> Column:
    return _stripped(F.split(strip(text), SENTENCE))


def packed_sentences(text: Column, size: int, trim=strip) -> Column:
    """A text that fits, or its sentences joined while they fit, with a space between ASCII characters; longer sentences are cut hard.

    trim is applied to the pieces of a text without sentences.
    """

    def step(parts, current, x):
        space = F.when(current.rlike(r"[\x00-\x7F]\z") & x.rlike(r"\A[\x00-\x7F]"), " ").otherwise("")
        candidate = F.concat(current, space, x)
        closed = F.when(current == "", parts).otherwise(F.array_append(parts, current))
        long, fits = F.length(x) > size, F.length(candidate) <= size
        return F.when(long, F.concat(closed, hard_pieces(x, size))).when(fits, parts).otherwise(closed), F.when(long, "").when(fits, candidate).otherwise(x)

    def units(own: Column) -> Column:
        return F.when(F.size(own) <= 1, hard_pieces(text, size, trim)).otherwise(_fold(own, step))

    return F.when(F.length(text) <= size, F.array(text)).otherwise(_let(sentences(text), units))


def is_table_line(line: Column) -> Column:
    return strip(line).rlike(r"(?s)\A\|.*\|\z")


def is_table_separator(line: Column) -> Column:
    return strip(line).rlike(r"\A\|+\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|+\z")


def has_table(text: Column) -> Column:
    return F.coalesce(F.exists(F.split(text, r"\R"), is_table_separator), F.lit(False))


def table_parts(rows: Column, size: int) -> Column:
    """Parts of a table (array of lines) of size characters at most, each under the first two lines."""

    def whole(lines: Column) -> Column:
        return F.array_join(lines, "\n")

    def split(header: Column) -> Column:
        def step(parts, current, row):
            more = F.concat(F.when(current == "", header).otherwise(current), F.lit("\n"), row)
            alone = F.concat(header, F.lit("\n"), row)
            closed = F.when(current == "", parts).otherwise(F.array_append(parts, current))
            ended = F.when(F.length(row) <= size, F.array_append(closed, alone)).otherwise(F.concat(closed, hard_pieces(alone, size)))
            fits, fits_alone = F.length(more) <= size, F.length(alone) <= size
            return F.when(fits, parts).when(fits_alone, closed).otherwise(ended), F.when(fits, more).when(fits_alone, alone).otherwise("")

        return _fold(F.slice(rows, 3, F.size(rows)), step)

    return F.when(F.length(whole(rows)) <= size, F.array(whole(rows))).when(F.size(rows) < 3, hard_pieces(whole(rows), size)).otherwise(_let(whole(F.slice(rows, 1, 2)), split))


def table_aware(text: Column, size: int) -> Column:
    """Tables and the texts between them, each split in its own way."""

    def blocks(lines: Column) -> Column:
        def kind(i: Column) -> Column:  # of a line: it starts a table, could go on with one, or neither
            line, following = F.get(lines, i), F.get(lines, i + 1)
            return F.struct(line.alias("line"), is_table_line(line).alias("row"), (is_table_line(line) & F.coalesce(is_table_separator(following), F.lit(False))).alias("start"))

        def step(done: Column, x: Column) -> Column:
            last = F.element_at(done, -1)
            goes_on = F.when(F.size(done) == 0, False).otherwise(F.when(last["table"], x["row"]).otherwise(~x["start"]))
            table = F.when(goes_on, last["table"]).otherwise(x["start"])
            line = F.when(table, strip(x["line"])).otherwise(x["line"])
            own = F.struct(table.alias("table"), F.when(goes_on, F.array_append(last["lines"], line)).otherwise(F.array(line)).alias("lines"))
            return F.array_append(F.when(goes_on, F.slice(done, 1, F.size(done) - 1)).otherwise(done), own)

        start = F.array().cast("array<struct<table:boolean,lines:array<string>>>")
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), kind), start, lambda s, x: step_when(s, x, step))

    def step_when(s: Column, x: Column, step) -> Column:
        empty = F.array(F.struct(x["start"].alias("table"), F.array(F.when(x["start"], strip(x["line"])).otherwise(x["line"])).alias("lines")))
        return F.when(F.size(s) == 0, empty).otherwise(step(s, x))

    found = _let(F.split(text, r"\R"), blocks)
    parts = F.transform(found, lambda b: F.when(b["table"], table_parts(b["lines"], size)).otherwise(_let(strip(F.array_join(b["lines"], "\n")), lambda t: packed_sentences(t, size))))
    return _stripped(F.flatten(parts))


def overlapped(parts: Column, overlap: int, size: int) -> Column:
    """Each part after the first begins with the end of the one before, from a boundary on; tables are left as they are."""
    n = min(overlap, max(size // 3, 1))
    if overlap <= 0:
        return parts

    def tail(text: Column) -> Column:
        window = F.substring(text, -n, n)
        after = [F.when(F.instr(window, b) > 0, strip(F.substring(window, F.instr(window, b) + len(b), F.lit(n)))) for b in TAIL_BOUNDARIES]
        return F.when(F.length(text) <= n, strip(text)).otherwise(F.coalesce(*(F.when(a != "", a) for a in after), strip(window)))

    def one(own: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        plain = (i == 0) | has_table(own) | has_table(before)
        return F.when(plain, own).otherwise(_let(tail(before), lambda t: F.when(t == "", own).otherwise(strip(F.concat(t, F.when(t.contains("\n") | own.contains("\n"), "\n").otherwise(" "), own)))))

    return F.transform(parts, one)


def split_text(text: Column, size: int, overlap: int = 0) -> Column:
    """Parts of a text: by tables if it has any, else by paragraphs and sentences."""
    plain = F.flatten(F.transform(packed_paragraphs(text, size), lambda p: packed_sentences(p, size)))
    return _let(_stripped(F.when(has_table(text), table_aware(text, size)).otherwise(plain)), lambda parts: overlapped(parts, overlap, size))


def split_reason(part: Column) -> Column:
    return F.when(has_table(part), "table_row_boundary").otherwise("sentence_boundary")


def joined_lines(texts: Column) -> Column:
    """Texts one under the other, without white space at their seams."""
    return F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1))), F.get(texts, 0), lambda a, x: strip(F.concat(F.regexp_replace(a, r"(?U)\s+$", ""), F.lit("\n"), x)))


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether text holds one of terms, whatever the case: as whole words where a term is of ASCII letters, digits, spaces and hyphens, else anywhere."""
    low = F.lower(text)
    words = [t.lower() for t in terms if t.isascii() and all(c.isalnum() or c in " -_" for c in t)]
    others = [t.lower() for t in terms if t.lower() not in words]
    found = [low.contains(t) for t in others]
    if words:
        found.append(low.rlike(r"(?U)\b(" + "|".join(t.replace(" ", r"\s+") for t in words) + r")\b"))
    return reduce(lambda a, b: a | b, found, F.lit(False))
