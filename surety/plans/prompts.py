"""Prompts. Templates are parameters: {question} and {answer} are filled in; the defaults have wordings of our own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import col
from surety.operators.tensor import hashed

DIRECT = {
    "en": "Give a short answer, key words only.\nQuestion: {question}\n",
    "ko": "핵심 단어만으로 짧게 답하세요.\n질문: {question}\n",
    "zh": "请只用关键词简短作答。\n问题: {question}\n",
    "es": "Da una respuesta breve, solo palabras clave.\nPregunta: {question}\n",
}
BINARY = {
    "en": 'Are you sure that you know the answer to this question? Reply "Yes" if you are, otherwise "No", and nothing else.\nQuestion: {question}\n',
    "ko": '이 질문의 답을 확실히 아십니까? 그렇다면 "예", 아니면 "아니요"라고만 답하세요.\n질문: {question}\n',
    "zh": '你确定知道这个问题的答案吗？确定请只回答"是"，否则只回答"否"。\n问题: {question}\n',
    "es": '¿Estás seguro de saber la respuesta a esta pregunta? Responde solo "Sí" o, si no, "No".\nPregunta: {question}\n',
}
DIRECT_OR_ABSTAIN = 'Give a short answer, key words only. If you cannot, reply "I don\'t know".\nQuestion: {question}\n'
#: Confidence probes by name.
META = {
    "binary": BINARY["en"],
    "graded": "Question: {question}\n\nHow sure are you of answering it correctly? Reply with one letter.\nA) certain\nB) probably\nC) not sure\nD) I do not know\n",
    "fok": "Question: {question}\n\nBefore you answer: how well do you feel you know it? Reply with one number from 1 (not at all) to 5 (for sure).\n",
    "jol": "This question was put to you, and you gave the answer below it. How likely is your answer to be correct? Reply with one number from 1 (surely wrong) to 5 (surely correct).\n\nQuestion: {question}\nYour answer: {answer}\n",
    "numeric": "How sure are you of answering this question correctly? Reply with one number from 1 (no idea) to 10 (no doubt).\n\nQuestion: {question}\n",
}


def fill(template: str, question, answer=None) -> Column:
    """The template with its places filled; braces inside the data are left alone, nulls are empty."""
    values = {"{question}": question, "{answer}": F.lit("") if answer is None else answer}
    parts = [p for p in re.split(r"(\{question\}|\{answer\})", template) if p]
    return F.concat(*[F.coalesce(col(values[p]), F.lit("")) if p in values else F.lit(p) for p in parts])


def _by_language(templates: dict[str, str], question, lang) -> Column:
    lang = F.coalesce(col(lang), F.lit("en"))
    of = lambda k: fill(templates[k], question)
    return F.when(lang == "ko", of("ko")).when(lang.startswith("zh"), of("zh")).when(lang == "es", of("es")).otherwise(of("en"))


def direct_prompt(question, lang=None, may_abstain=False) -> Column:
    if may_abstain:
        return fill(DIRECT_OR_ABSTAIN, question)
    return fill(DIRECT["en"], question) if lang is None else _by_language(DIRECT, question, lang)


def meta_prompt(meta_type: str, question, lang=None, answer=None, templates: dict[str, str] = META) -> Column:
    """The probe's prompt. Only the binary probe has other languages. answer: for probes after answering, else empty."""
    if meta_type not in templates:
        raise ValueError(f"unknown probe {meta_type!r}; one of {', '.join(templates)}")
    if meta_type == "binary" and lang is not None:
        return _by_language(BINARY, question, lang)
    return fill(templates[meta_type], question, F.lit("") if answer is None else answer)


def build_prompts(questions: DataFrame, meta_type: str, dataset: str | None = None, lang: str | None = None) -> DataFrame:
    """Adds direct_prompt and meta_prompt; languages are routed for the multilingual corpus only."""
    spoken = F.lit(lang) if lang is not None and dataset == "mkqa" else None
    return questions.withColumns({"direct_prompt": direct_prompt("question", spoken), "meta_prompt": meta_prompt(meta_type, "question", spoken)})


def judged_prompts(questions: DataFrame, answers: DataFrame, key="question_id", template: str = META["jol"]) -> DataFrame:
    """Prompts for judging one's own answer: answers (key, answer) are joined in; questions without one get an empty answer."""
    joined = questions.join(answers.select(key, F.col("answer").alias("_own")), key, "left")
    return joined.withColumn("meta_prompt", fill(template, "question", F.coalesce("_own", F.lit("")))).drop("_own")


def chat_turn(prompt, template: str | None = None) -> Column:
    """A single user turn with generation prompt if a template with {prompt} is given, else the text itself."""
    return col(prompt) if template is None else F.replace(F.lit(template), F.lit("{prompt}"), col(prompt))


def chat_messages(prompt, reply=None) -> Column:
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), col(what).alias("content"))
    return F.array(turn("user", prompt), *([turn("assistant", reply)] if reply is not None else []))


def tuning_pairs(questions: DataFrame, seed: int = 42) -> DataFrame:
    """Adds messages: the direct prompt and one of the answers, chosen by a hash of the key and seed."""
    pick = F.pmod(hashed("question_id", F.lit(seed)), F.greatest(F.size("answers"), F.lit(1))).cast("int") + 1
    reply = F.coalesce(F.try_element_at("answers", pick), F.lit(""))
    return questions.withColumn("messages", chat_messages(direct_prompt("question"), reply))


def tuning_triples(questions: DataFrame, meta_type: str = "binary") -> DataFrame:
    """Adds the direct prompt and the meta conversation ending in No (first) and Yes (second)."""
    meta = meta_prompt(meta_type, "question")
    return questions.withColumns({"direct_prompt": direct_prompt("question"), "meta_messages": F.array(chat_messages(meta, F.lit("No")), chat_messages(meta, F.lit("Yes")))})
