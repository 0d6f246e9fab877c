"""Intent, route and visual wish of questions by fixed words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the routing behaviour.
OUT_OF_SCOPE = ("今天天气", "几点了", "翻译成英文", "翻译成中文", "股票", "新闻", "today's weather", "what time is it", "translate this", "stock price")
GREETINGS = ("hi", "hello", "hey", "ok", "thanks", "thank you", "你好", "您好", "谢谢", "好的")
COMPARISONS = ("compare", "difference", "different", "versus", " vs ", "better", "which is", "哪个更", "哪一个更", "区别", "对比", "比较")
STEPS = ("first", "then", "after", "before", "based on", "depends on", "follow up", "再", "然后", "之后", "先", "根据")
MODEL = r"\b[a-z]{1,8}[-_ ]?\d{1,5}[a-z]?\b"
VISUAL = ("show", "diagram", "image", "picture", "photo", "button", "where is", "layout")
VISUAL_CJK = ("图", "图片", "示意图", "按钮", "位置", "在哪", "长什么样", "给我看")


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def intent(question: Column, words: tuple[str, ...] = OUT_OF_SCOPE) -> Column:
    """OUT_OF_SCOPE for questions with one of the words anywhere, else TEXT_ANSWER; null is an empty question."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.when(holds_any(low, tuple(w.lower() for w in words)), "OUT_OF_SCOPE").otherwise("TEXT_ANSWER") if words else F.lit("TEXT_ANSWER")


def plain(question: Column) -> Column:
    """In lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"(?U)\s+", " "))


def model_mentions(question: Column) -> Column:
    """How many different model names a plain question holds."""
    return F.size(F.array_distinct(F.regexp_extract_all(question, F.lit("(?U)" + MODEL), F.lit(0))))


def route(question: Column, out_of_scope: Column | None = None, most_values: Column | None = None) -> Column:
    """no_retrieval, multi_hop or single_shot. most_values: of the filters that are lists, how many values the longest has."""
    low = plain(question)
    none = (low == "") | low.isin(*GREETINGS) | (intent(question) == "OUT_OF_SCOPE" if out_of_scope is None else out_of_scope)
    several = model_mentions(low) >= 2
    if most_values is not None:
        several = several | (F.coalesce(most_values, F.lit(0)) >= 2)
    return F.when(none, "no_retrieval").when(holds_any(low, COMPARISONS) | holds_any(low, STEPS) | several, "multi_hop").otherwise("single_shot")


def route_confidence(found: Column) -> Column:
    return F.when(found == "no_retrieval", 0.95).when(found == "multi_hop", 0.75).otherwise(0.6)


def visual(question: Column) -> Column:
    """Whether a question asks for something to look at."""
    text = F.coalesce(question, F.lit(""))
    return holds_any(F.lower(text), VISUAL) | holds_any(text, VISUAL_CJK)
