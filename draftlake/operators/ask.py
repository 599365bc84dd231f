"""Questions: parsing on the driver, templates as DataFrames, fallbacks and gates, an extractive answer."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions import similarity, text
from draftlake.operators import knowledge, ranking, routing

#: Words that ask for rooms or lists, and synonyms; fixed values.
ROOM_WORDS = {"방", "실", "룸", "공간", "방들", "room", "rooms", "space", "spaces"}
LIST_WORDS = {"목록", "리스트", "전체", "모든", "모두", "list", "all"}
SYNONYMS = {"h형강": ["H-", "형강"], "c형강": ["C-", "형강"], "ㄷ형강": ["C-", "형강"], "ㄱ형강": ["L-", "형강"], "앵글": ["L-", "형강"]}
STOREYS = re.compile("(?i)" + "|".join(p.removeprefix("(?i)") for p in (*text.BASEMENT, text.ROOF, text.FLOOR)))


@dataclass
class Parsed:
    terms: list[str] = field(default_factory=list)
    storey: str | None = None
    kind: str | None = None


def storey_names(question: str) -> set[str]:
    left = re.sub(text.RANGE, " ", question)
    return {f"B{int(a or b)}" if a or b else "RF" if roof else f"{int(n)}F" for a, b, roof, n in STOREYS.findall(left)}


def parse(question: str) -> Parsed:
    """Terms, storey and kind of one question: a storey that it names alone is taken out, room words set the kind."""
    out, names = Parsed(), storey_names(question)
    if len(names) == 1:
        out.storey = names.pop()
        question = re.sub(text.storey_pattern(out.storey), " ", question)
    for word in question.split():
        low = word.lower()
        if low in ROOM_WORDS:
            out.kind = "Space"
        elif low not in LIST_WORDS:
            out.terms += SYNONYMS.get(low, [word])
    return out


def translate(question: str, glossary: dict[str, str], stop: frozenset[str] = frozenset({"the", "a", "an", "of", "on", "in", "for"}), longest: int = 4) -> str:
    """Longest glossary phrase first; ordinals and numbers before `floor` become storeys; codes stay; stop words go."""
    question = re.sub(r"(?i)\b(\d{1,3})(?:st|nd|rd|th)?\s+floor\b|\bfloor\s+(\d{1,3})\b", lambda m: f"{m[1] or m[2]}F", question)
    words, out, at = question.split(), [], 0
    while at < len(words):
        for n in range(min(longest, len(words) - at), 0, -1):
            phrase = " ".join(words[at : at + n]).lower().strip("?.,!")
            if phrase in glossary:
                out.append(glossary[phrase])
                at += n
                break
        else:
            if words[at].lower() not in stop:
                out.append(words[at].strip("?.,!"))
            at += 1
    return " ".join(out)


def storey_filter(level: str):
    """The storey column if it is filled, else the texts."""
    pattern = text.storey_pattern(level)
    blank = F.coalesce(F.col("storey"), F.lit("")) == ""
    return F.col("storey").rlike(pattern) | (blank & F.concat_ws(" ", "name", "search_text").rlike(pattern))


def candidates(nodes: DataFrame, question: str, most: int) -> DataFrame:
    """Nodes (id, type, name, search_text, project_key) that hold a term, by the share of terms."""
    terms = parse(question).terms
    own = nodes.withColumn("score", similarity.contained_score(F.col("search_text"), terms)).where("score > 0")
    return ranking.top_k(own, most, F.desc("score"), F.length("name"), F.col("name"), F.col("id"))


def retrieve(nodes: DataFrame, question: str, route: str, most: int = 10) -> DataFrame:
    """Context of a question: its route's template, topped up by words when it gives under three; id, score, text.

    The plan is one union; the template's rows come first, duplicates keep their first place.
    """
    kinds = {"graph:room": "Space", "graph:storey": "Space", "graph:section": "Section", "graph:drawings": "Drawing", "keyword:sheet": "Drawing", "graph:revision": "Series", "summary": "Project", "graph:elements": "ElementGroup"}
    parsed = parse(question)
    template = nodes.where(F.col("type") == kinds[route]) if route in kinds else nodes.limit(0)
    if parsed.storey:
        template = template.where(F.col("search_text").rlike(text.storey_pattern(parsed.storey)))
    template = candidates(template, question, most) if parsed.terms else ranking.top_k(template.withColumn("score", F.lit(1.0)), most, F.col("id"))
    first = template.select("id", "name", "score", F.lit(0).alias("leg"))
    second = candidates(nodes, question, most).select("id", "name", "score", F.lit(1).alias("leg"))
    both = first.unionByName(second)
    enough = first.agg((F.count("*") >= 3).alias("enough"))  # one row
    both = both.join(F.broadcast(enough)).where("leg = 0 or not enough").groupBy("id", "name").agg(F.min(F.struct("leg", (-F.col("score")).alias("s"))).alias("m"))
    return both.select("id", F.col("name").alias("text"), (-F.col("m.s")).alias("score"), "m.leg").orderBy("leg", F.desc("score"), "id").limit(most)


def answer(nodes: DataFrame, questions: list[str], most: int = 5) -> DataFrame:
    """question, answer for each question of a bounded list: route, retrieve, extract; no evidence is a refusal."""
    spark, out = nodes.sparkSession, None
    for k, question in enumerate(questions):
        asked = spark.range(1).select(routing.linked(F.lit(question)).alias("l"))
        route, refusal = asked.select(routing.route(F.col("l")), routing.refusal(F.lit(question), F.col("l"))).first()
        if refusal is not None:
            row = spark.createDataFrame([(question, "no evidence")], "question string, answer string")
            out = row if out is None else out.unionByName(row)
            continue
        found = retrieve(nodes, question, route, most).select(F.lit(k).alias("question_id"), F.col("id").alias("cid"), "text", "score")
        got = knowledge.extract_answer(found)
        asked = spark.createDataFrame([(k, question)], "question_id int, question string").join(got, "question_id", "left")
        row = asked.select("question", F.coalesce("answer", F.lit("no evidence")).alias("answer"))
        out = row if out is None else out.unionByName(row)
    return out
