"""Text scalars: normalisers, identities, token classes and counts, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+(?:[-_][a-z0-9]+)*"
CODE = r"^[a-z]{1,4}[- ]?[0-9]{1,5}[a-z0-9]*$"
CJK = "[㐀-鿿]+"
# Fixed values of the lexical behaviour.
STOP_WORDS = ("a", "an", "and", "for", "if", "in", "is", "of", "on", "or", "the", "to", "with")
CJK_STOP_TERMS = ("洗衣", "衣機", "洗衣機", "洗衣机", "烘乾", "烘干", "乾衣", "干衣", "烤箱", "冰箱", "怎麼", "怎么", "哪裡", "哪里", "如何", "什麼", "什么")


def normalized_tag(tag: Column) -> Column:
    """Lower case with single hyphens for white space and everything outside a-z, 0-9, colon and hyphen."""
    hyphened = F.regexp_replace(F.lower(F.trim(tag)), r"[\s_]+", "-")
    plain = F.regexp_replace(hyphened, "[^a-z0-9:-]+", "-")
    return F.regexp_replace(F.regexp_replace(plain, "-+", "-"), "^-|-$", "")


def normalized_identifier(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.replace(name, F.lit("\\"), F.lit("/"))), "[^a-z0-9/._-]+", "-")
    joined = F.regexp_replace(F.regexp_replace(plain, "[/_.]", "-"), "-+", "-")
    trimmed = F.regexp_replace(joined, "^-|-$", "")
    return F.when(trimmed == "", "manual").otherwise(trimmed)


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9㐀-鿿]", "")


def singular(word: Column) -> Column:
    """An English plural's singular, by ending, with guards against short words."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 5) & word.endswith("sses"), word.substr(F.lit(1), n - 2))
        .when((n > 4) & word.rlike("(ches|shes|xes|zes)$"), word.substr(F.lit(1), n - 2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_class(token: Column) -> Column:
    """model, exact_code, ordinary or null for a token that doesn't count."""
    flat = F.regexp_replace(token, "[-_]", "")
    mixed = flat.rlike("[a-z]") & flat.rlike("[0-9]")
    return (
        F.when(token.rlike("^[0-9]+$"), F.lit(None))
        .when((F.length(flat) >= 4) & mixed, "model")
        .when(token.rlike(CODE) | flat.rlike(CODE), "exact_code")
        .when((F.length(token) >= 2) & ~token.isin(*STOP_WORDS), "ordinary")
    )


def cjk_terms(text: Column) -> Column:
    """Runs of CJK characters of two or more, and their grams of two and three."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(CJK), F.lit(0)), lambda r: F.length(r) >= 2)

    def grams(run: Column, n: int) -> Column:
        return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs, F.flatten(F.transform(runs, lambda r: grams(r, 2))), F.flatten(F.transform(runs, lambda r: grams(r, 3)))))


def anchor_key(path: Column, header: Column, text: Column) -> Column:
    joined = F.concat(F.array_join(path, "|"), F.lit("|"), header, F.lit("|"), F.substring(text, 1, 80))
    return F.substring(F.sha2(joined, 256), 1, 12)


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def query_hash(question: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.trim(question), 256))


def vector_point_id(chunk_id: Column, model: Column, version: Column) -> Column:
    digest = F.sha2(F.concat_ws("\u0000", chunk_id, model, version), 256)
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.expr("0") + F.floor((F.length(text) + 3) / 4)).cast("long")


def masked_pii(text: Column, patterns: dict[str, str]) -> Column:
    """Every pattern in turn replaced by its name in brackets."""
    for name, pattern in patterns.items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def hard_split(text: Column, size: int) -> Column:
    """Pieces of size characters, trimmed; empty ones are dropped."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i + 1, F.lit(size)))), lambda x: x != "")
