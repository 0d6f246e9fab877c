"""Extractive answers: excerpts of the context, or of the evidence, that bear on a question, under their citations."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmere.functions.chunking import any_of
from sparkmere.operators.evidence import TROUBLE_TERMS, answer_intent

# Fixed values of the answers.
SAFETY = (
    "abnormal smell", "burning smell", "electric shock", "overheat", "overheating", "disconnect power", "unplug", "contact service", "异味", "異味", "漏电", "漏電", "触电", "觸電",
    "过热", "過熱", "持续高温", "持續高溫", "立即断电", "立即斷電", "联系售后", "聯絡售後",
)
REPAIR = ("part number", "spare part", "replace", "replacement", "disassemble", "配件编号", "零件编号", "料号", "料號", "更换", "更換", "换泵", "換泵", "拆机", "拆機", "拆卸")
ACTIONS = (
    "clean", "check", "confirm", "wait", "reset", "清洗", "清洁", "清潔", "检查", "檢查", "确认", "確認", "安装到位", "安裝到位", "预热", "預熱", "等待", "重启", "重啟",
)
IGNORED_CJK = ("的", "了", "和", "是", "在", "个", "吗")
GENERIC = ("是否", "是不是", "直接", "故障", "需要", "可以", "how", "what", "should")
STEPWISE, GENERAL, SAFE, UNSUPPORTED = "建议先这样处理：", "根据资料可确认：", "建议先保证安全：", "现有说明书证据不足，无法确认需要这样处理。"
NOTHING = "The available evidence is insufficient to produce an extractive answer."
MOST_EXCERPTS, MOST_CHARS, FINGERPRINT = 3, 480, 160
CJK = "[一-鿿]"


def _plain_terms(text: str) -> set[str]:
    low = text.lower()
    words = [w for w in re.findall("[a-z0-9]+", low) if len(w) >= 3]
    return {*words, *(w[:-1] for w in words if len(w) > 3 and w.endswith("s")), *(c for c in re.findall(CJK, low) if c not in IGNORED_CJK)}


#: Terms that are no subject of a question.
NO_SUBJECT = tuple(sorted(_plain_terms(" ".join(REPAIR + TROUBLE_TERMS + ACTIONS)) | set(GENERIC)))


def relevance_terms(text: Column) -> Column:
    """Distinct words of three characters or more, plurals also without their s, and CJK characters but for the most common."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    singles = F.transform(F.filter(words, lambda w: (F.length(w) > 3) & w.endswith("s")), lambda w: F.substring(w, F.lit(1), F.length(w) - 1))
    return F.array_distinct(F.concat(words, singles, F.filter(F.regexp_extract_all(low, F.lit(CJK), F.lit(0)), lambda c: ~c.isin(*IGNORED_CJK))))


def relevant(question: Column, excerpt: Column) -> Column:
    """Whether an excerpt bears on a question: both are about safety; it tells of repairs, or of steps against a trouble, of the question's subject; or they
    share two terms, or all that the question has."""
    asked, held = relevance_terms(question), relevance_terms(excerpt)
    subject = lambda terms: F.filter(terms, lambda t: ~t.isin(*NO_SUBJECT))
    same_subject = F.size(F.array_intersect(subject(asked), subject(held))) > 0
    strong = F.size(F.filter(subject(asked), lambda t: (F.length(t) > 1) | t.rlike(r"^[\x00-\x7F]+$"))) >= 2
    needs_subject = question.rlike(r"[A-Za-z]{2,}\s*[A-Za-z0-9-]{2,}") | strong
    repair = any_of(question, REPAIR)
    rules = [
        repair & any_of(excerpt, REPAIR) & same_subject,
        any_of(question, SAFETY) & any_of(excerpt, SAFETY),
        ~repair & question.rlike(CJK) & any_of(question, TROUBLE_TERMS) & any_of(excerpt, ACTIONS) & (~needs_subject | same_subject),
        F.size(F.array_intersect(asked, held)) >= F.least(F.lit(2), F.size(asked)),
    ]
    return reduce(lambda a, b: a | b, rules)


def clean_excerpt(text: Column, most: int = MOST_CHARS) -> Column:
    """A text without its heading, with single spaces, cut to most characters, at the end of a sentence if one ends beyond the first third."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")

    def headed(own: Column) -> Column:
        first = F.get(own, 0)
        heading = F.get(own, 1).startswith(first) | ((F.length(first) <= 80) & ~first.rlike(r"[。.!?！？；;]"))
        rest = F.array_join(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), "\n")
        return F.when((F.size(own) >= 2) & heading, rest).otherwise(F.coalesce(text, F.lit("")))

    def cut(flat: Column) -> Column:
        clipped = F.rtrim(F.substring(flat, 1, most))
        places = [F.length(clipped) - F.instr(F.reverse(clipped), F.lit(mark[::-1])) - 1 for mark in (". ", "; ", "! ", "? ")]
        found = [(F.instr(F.reverse(clipped), F.lit(mark[::-1])) > 0) & (place >= most // 3) for mark, place in zip((". ", "; ", "! ", "? "), places, strict=True)]
        ended = reduce(lambda rest, x: F.when(x[0], F.trim(F.substring(clipped, F.lit(1), x[1] + 1))).otherwise(rest), reversed(list(zip(found, places, strict=True))), F.regexp_replace(clipped, "[ ,;:]+$", ""))
        return F.when(F.length(flat) <= most, flat).otherwise(ended)

    once = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    return once(once(lines, headed), lambda x: once(F.trim(F.regexp_replace(x, r"\s+", " ")), cut))


def _step(text: str) -> str:
    return text if text.strip().endswith(("。", ".", "!", "?", "！", "？")) else f"{text.strip()}。"


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """One query's answer: the first excerpts of the context that are relevant, else of the evidence, else (but for repairs) the first of all."""
    rows = rows.sort_values(["stage", "at"])
    repair, asks_safety, trouble = (bool(rows[c].iloc[0]) for c in ("repair", "asks_safety", "trouble"))

    def once(own: pd.DataFrame) -> pd.DataFrame:
        cited, seen, kept = set(), set(), []
        for k, citation, text in zip(own.index, own["citation_id"], own["excerpt"], strict=True):
            mark = re.sub(r"\W+", "", text.casefold())[:FINGERPRINT]
            if citation not in cited and mark not in seen:
                cited.add(citation)
                seen.add(mark)
                kept.append(k)
        return own.loc[kept[:MOST_EXCERPTS]]

    relevant_ = rows[rows["relevant"]]
    chosen = once(relevant_[relevant_["stage"] == 0])
    if chosen.empty:
        chosen = once(relevant_[relevant_["stage"] == 1])
    if chosen.empty and not repair:
        chosen = once(rows)
    safe = chosen[chosen["safety"]]
    pairs = list(zip(chosen["excerpt"], chosen["citation_id"], strict=True))

    def stepwise(prefix: str, own: list, before: str = "") -> str:
        return "\n".join([prefix, *(f"{k}. {before}{_step(text)} [{citation}]" for k, (text, citation) in enumerate(own, 1))])

    if not pairs:
        answer = NOTHING
    elif repair:
        answer = f"{UNSUPPORTED} 可确认的信息是：{_step(pairs[0][0])} [{pairs[0][1]}]" if len(pairs) == 1 else stepwise(UNSUPPORTED, pairs, "可确认的信息：")
    elif asks_safety and len(safe):
        answer = stepwise(SAFE, list(zip(safe["excerpt"], safe["citation_id"], strict=True)))
    elif len(pairs) == 1:
        answer = f"{pairs[0][0]} [{pairs[0][1]}]"
    else:
        answer = stepwise(STEPWISE if trouble else GENERAL, pairs)
    return pd.DataFrame([{"query_id": rows["query_id"].iloc[0], "answer": answer, "citations": [c for _, c in pairs]}])


def extractive_answers(questions: DataFrame, excerpts: DataFrame) -> DataFrame:
    """query_id, answer, citations of every question (query_id, text).

    excerpts: query_id, stage (0 the context's items, 1 the evidence), at, citation_id, text: those that may be cited, a bounded number a query. A question
    without any has the answer that nothing suffices.
    """
    asked = questions.select("query_id", F.coalesce("text", F.lit("")).alias("question"))
    rows = excerpts.select("query_id", "stage", "at", "citation_id", clean_excerpt(F.col("text")).alias("excerpt")).where("excerpt <> '' AND citation_id IS NOT NULL").join(asked, "query_id")
    question, excerpt = F.col("question"), F.col("excerpt")
    rows = rows.withColumns({"relevant": relevant(question, excerpt), "safety": any_of(excerpt, SAFETY), "repair": any_of(question, REPAIR), "asks_safety": any_of(question, SAFETY), "trouble": answer_intent(question) == "troubleshooting"})
    found = rows.drop("question").groupBy("query_id").applyInPandas(_answered, "query_id long, answer string, citations array<string>")
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NOTHING)).alias("answer"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))
