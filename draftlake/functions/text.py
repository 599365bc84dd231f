"""Text rules as column expressions. Word lists and patterns of the domain are fixed values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "[0-9A-Za-z가-힣]+"

#: Discipline codes by sheet-number prefix; fixed values.
DISCIPLINE_PREFIX = {
    "A": "ARCH", "AR": "ARCH", "S": "STRUCT", "ST": "STRUCT", "M": "MECH", "ME": "MECH", "P": "PLUMB", "E": "ELEC", "EL": "ELEC",
    "F": "FIRE", "FP": "FIRE", "C": "CIVIL", "L": "LAND", "T": "COMM", "I": "INTERIOR", "G": "GENERAL",
}
#: Discipline words in order of precedence; fixed values.
DISCIPLINE_WORDS = [
    ("구조", "STRUCT"), ("철골", "STRUCT"), ("전기", "ELEC"), ("통신", "COMM"), ("기계", "MECH"), ("설비", "MECH"), ("위생", "PLUMB"),
    ("소방", "FIRE"), ("토목", "CIVIL"), ("조경", "LAND"), ("인테리어", "INTERIOR"), ("건축", "ARCH"),
]
#: Drawing categories in order of precedence (name, code, group, patterns); fixed values.
DRAWING_CATEGORIES = [
    ("철골상세도", "steel_detail", "detail", ["철골.*상세", "STEEL.*DETAIL", r"CONNECTION\s+DETAIL", "접합.*상세"]),
    ("구조평면도", "structural_plan", "structural", ["구조.*평면", "STRUCTURAL.*PLAN", r"FRAMING\s+PLAN", r"(보|기둥|슬래브)\s*배근", "골조.*평면"]),
    ("일람표", "schedule", "schedule", ["일람", "SCHEDULE", "리스트표", "부재표", "마감표"]),
    ("창호도", "door_window", "detail", ["창호", r"WINDOW\s+(ELEVATION|DETAIL)", r"DOOR\s*(&|AND)?\s*WINDOW"]),
    ("표지/목록", "cover_index", "cover", ["표지", "목록", "COVER", r"DRAWING\s+(LIST|INDEX)", r"\bINDEX\b"]),
    ("상세도", "detail", "detail", ["상세", "DETAIL", r"\bDET\b", "확대"]),
    ("단면도", "section", "section", ["단면", "SECTION"]),
    ("입면도", "elevation", "elevation", ["입면", "정면도", "측면도", "배면도", "ELEVATION"]),
    ("배치도", "site_plan", "plan", ["배치", r"SITE\s*PLAN", r"LAYOUT\s+PLAN"]),
    ("평면도", "plan", "plan", ["평면", r"\bPLAN\b", "FLOOR", r"\d+\s*층", r"\bB?\d+F\b"]),
]
#: Least number of dimensions of a steel shape; fixed values.
STEEL_LEAST = {"H": 2, "I": 2, "BH": 2, "C": 2, "L": 2, "T": 2, "□": 2, "ㅁ": 2, "SHS": 2, "RHS": 2, "PIPE": 1, "P": 2, "FB": 2, "PL": 1}
RANGE = r"(?i)(?:지하|지상|(?<![A-Z0-9])B)?\s*\d{1,3}\s*(?:층|FL|F)?\s*[~\-–～]\s*(?:지하|지상|B)?\s*\d{1,3}\s*(?:층|FL|F)?"
BASEMENT = [r"(?i)지하\s*(\d{1,2})\s*층", r"(?i)(?<![A-Z0-9])B\s*(\d{1,2})\s*(?:FL|F|층)?(?![A-Z0-9])"]
ROOF = r"(?i)(지붕|옥상|옥탑|(?<![A-Z0-9])(?:RF|ROOF)(?![A-Z0-9]))"
FLOOR = r"(?i)(?<![A-Z0-9~\-])(\d{1,3})\s*(?:층|(?:FL|F)(?![A-Z0-9]))"
#: Every text that names a storey has one of these.
STOREY_LETTERS = "(?i)[BF층지옥]"
EMAIL, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+?[0-9]{2,4}[- ][0-9]{3,4}[- ][0-9]{4}"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def token_list(text: Column) -> Column:
    """Lower-case words of Latin letters, digits and Hangul, with repeats."""
    return every(F.lower(text), WORD)


def token_set(text: Column) -> Column:
    return F.array_distinct(token_list(text))


def scrub(text: Column) -> Column:
    """Text without e-mail addresses and phone numbers, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(text, EMAIL, " "), PHONE, " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def storeys(text: Column) -> Column:
    """Distinct storeys that a text names (B1, 3F, RF), after ranges such as 1~3F are removed; sorted."""
    left = F.regexp_replace(F.coalesce(text, F.lit("")), RANGE, " ")
    found = []
    for pattern in BASEMENT:
        found.append(F.transform(every(left, pattern, 1), lambda n: F.concat(F.lit("B"), n.cast("int").cast("string"))))
        left = F.regexp_replace(left, pattern, " ")
    found.append(F.transform(every(left, ROOF, 1), lambda n: F.lit("RF")))
    left = F.regexp_replace(left, ROOF, " ")
    floors = F.filter(F.transform(every(left, FLOOR, 1), lambda n: n.cast("int")), lambda n: n > 0)
    found.append(F.transform(floors, lambda n: F.concat(n.cast("string"), F.lit("F"))))
    return F.when(text.rlike(STOREY_LETTERS), F.array_sort(F.array_distinct(F.concat(*found)))).otherwise(F.array().cast("array<string>"))


def only(values: Column) -> Column:
    """The single element of an array, null if there is none or more than one."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def storey_from(*texts: Column) -> Column:
    """Storey of the first text that names exactly one."""
    return F.coalesce(*[only(storeys(t)) for t in texts])


def storey_from_layer(layer: Column) -> Column:
    return only(storeys(F.regexp_replace(layer, r"[-_.$|:/\\]+", " ")))


def normal_storey(text: Column) -> Column:
    """2층, 2f, B1F, 지하1층 and 2 as 2F and B1; other text is trimmed, blank is null."""
    own = F.trim(text)
    named = storeys(own)
    basement = F.regexp_extract(own, r"(?i)^B\s*(\d{1,2})$", 1)
    return (
        F.when(own.isNull() | (own == ""), F.lit(None))
        .when(own.rlike(r"\A[1-9]\d{0,2}F\z"), own)
        .when(F.size(named) == 1, F.element_at(named, 1))
        .when(basement != "", F.concat(F.lit("B"), basement.cast("int").cast("string")))
        .when(own.rlike(r"^\d+$") & (own.cast("int") > 0), F.concat(own.cast("int").cast("string"), F.lit("F")))
        .otherwise(own)
    )


def storey_order(level: Column) -> Column:
    """Basements from the lowest up, then floors, then the roof, then the rest."""
    number = F.regexp_extract(level, r"(\d+)", 1).cast("int")
    return (
        F.when(level.rlike(r"^B\d+$"), F.struct(F.lit(0).alias("a"), (-number).alias("b")))
        .when(level.rlike(r"^\d+F$"), F.struct(F.lit(1).alias("a"), number.alias("b")))
        .when(level == "RF", F.struct(F.lit(2).alias("a"), F.lit(0).alias("b")))
        .otherwise(F.struct(F.lit(3).alias("a"), F.lit(0).alias("b")))
    )


def storey_pattern(level: str) -> str:
    """Pattern that finds a normalised storey in free text."""
    if level == "RF":
        body = "(옥상|옥탑|지붕|rf|roof)"
    elif level[:1] == "B" and level[1:].isdigit():
        body = f"(지하 ?0*{level[1:]} ?층?|b0*{level[1:]} ?(f|fl)?)"
    elif level[-1:] == "F" and level[:-1].isdigit():
        body = f"(0*{level[:-1]} ?(층|fl|f))"
    else:
        raise ValueError(level)
    return f"(?i)(^|[^0-9a-z가-힣]){body}(?![0-9a-z])"


def review_state(confidence: Column) -> Column:
    return F.when(confidence > 0.95, "AUTO_ACCEPT").when(confidence >= 0.75, "ACCEPT_WITH_WARNING").otherwise("REQUIRE_VALIDATION")


MARK = r"^(SSD|ASD|SD|WD|FD|AD|ALD|GD|PD|HD|D|SSW|AW|PW|SW|ALW|WW|FW|W|SC|TC|C)-?([0-9]{1,3}[A-Z]?)$"


def mark(text: Column) -> Column:
    """Door, window or column tag: struct(mark, kind), null for other text."""
    own = F.upper(F.regexp_replace(text, r"\s+", ""))
    head, tail = F.regexp_extract(own, MARK, 1), F.regexp_extract(own, MARK, 2)
    kind = F.when(F.endswith(head, F.lit("D")), "Door").when(F.endswith(head, F.lit("W")), "Window").otherwise("Column")
    return F.when(head != "", F.struct(F.concat(head, tail).alias("mark"), kind.alias("kind")))


def room(text: Column) -> Column:
    """Key under which room names merge: no white space, no edge punctuation, lower case; null if nothing is left."""
    key = F.lower(F.btrim(F.regexp_replace(text, r"\s+", ""), F.lit(" .:-_")))
    return F.when(key != "", key)


def section(text: Column) -> Column:
    """A steel section's canonical designation: H-300x150x6.5x9; plates and flat bars thickness first."""
    own = F.replace(F.translate(F.upper(text), "×*", "XX"), F.lit(" "), F.lit(""))
    shape = F.regexp_extract(own, r"^(BH|SHS|RHS|PIPE|FB|PL|H|I|C|L|T)-?(\d.*)$", 1)
    parts = F.filter(F.split(F.regexp_extract(own, r"^(BH|SHS|RHS|PIPE|FB|PL|H|I|C|L|T)-?(\d.*)$", 2), "X"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    numbers = F.when(shape.isin("PL", "FB") & (F.size(numbers) == 2), F.array_sort(numbers)).otherwise(numbers)
    shown = F.transform(numbers, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", ""))
    bad = F.exists(numbers, lambda x: x.isNull())
    return F.when(text.isNull() | (text == ""), F.lit(None)).when((shape == "") | bad, own).otherwise(F.concat(shape, F.lit("-"), F.array_join(shown, "x")))


STEEL = r"(?<![A-Za-z0-9])(BH|PIPE|SHS|RHS|FB|PL|H|I|C|L|T|P|□|ㅁ)\s*-?\s*(\d+(?:\.\d+)?(?:\s*[X×*]\s*\d+(?:\.\d+)?){0,4})(?:\s*T\s*(\d+(?:\.\d+)?))?"


def steel_sections(text: Column) -> Column:
    """All steel designations in a text, in order: array of struct(shape, dimensions, designation)."""
    own = F.translate(F.upper(text), "ØΦ", "")

    def one(hit):
        shape = F.regexp_extract(hit, STEEL, 1)
        dims = F.filter(F.split(F.regexp_replace(F.regexp_extract(hit, STEEL, 2), r"\s+", ""), "[X×*]"), lambda x: x != "")
        thick = F.regexp_extract(hit, STEEL, 3)
        dims = F.when(thick != "", F.concat(dims, F.array(thick))).otherwise(dims)
        least = F.create_map(*[F.lit(x) for kv in STEEL_LEAST.items() for x in kv])[shape]
        square = F.when(F.element_at(dims, 1) == F.try_element_at(dims, F.lit(2)), "SHS").otherwise("RHS")
        name = F.when(shape.isin("□", "ㅁ"), square).when(shape == "P", "PIPE").otherwise(shape)
        return F.struct(name.alias("shape"), dims.alias("dimensions"), F.concat(name, F.lit("-"), F.array_join(dims, "x")).alias("designation"), (F.size(dims) >= least).alias("whole"))

    return F.filter(F.transform(every(own, STEEL), one), lambda s: s["whole"])


def drawing_category(*texts: Column) -> Column:
    """Category of the first text that matches one, in order: struct(name, code, group, source number); other if none."""
    ladder = []
    for k, text in enumerate(texts):
        for name, code, group, patterns in DRAWING_CATEGORIES:
            hit = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
            ladder.append(F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(code).alias("code"), F.lit(group).alias("group"), F.lit(k).alias("source"))))
    return F.coalesce(*ladder, F.struct(F.lit("기타").alias("name"), F.lit("other").alias("code"), F.lit("other").alias("group"), F.lit(-1).alias("source")))


def discipline(number: Column, place: Column) -> Column:
    """Discipline from a sheet number's prefix, else from words of the path and name."""
    table = F.create_map(*[F.lit(x) for kv in DISCIPLINE_PREFIX.items() for x in kv])
    head = F.regexp_extract(F.upper(number), "^[A-Z]{1,2}", 0)
    words = [F.when(F.contains(place, F.lit(w)), F.lit(code)) for w, code in DISCIPLINE_WORDS]
    return F.coalesce(table[head], table[F.substring(head, 1, 1)], *words)


DATE = r"(?:(?<=[_\-\s(\[])|^)((?:20)?\d{2}[01]\d[0-3]\d|[01]\d[0-3]\d)(?=$|[_\-\s)\].])"
COPY = r"(?i)(\s*-\s*복사본(\s*\(\d+\))?|복사본|\s*\(\d{1,2}\)$|\bcopy\b|_?최종본?|_?수정본?|_?final|[_\s-]?rev\.?\s*\d+|[_\s-]r\d{1,2}$|[_\s-]v\d{1,2}$|\(수정\)|\(최종\))"


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?i)\.(dwg|dxf|pdf)$", "")


def date_token(name: Column) -> Column:
    """The last valid date (MMDD or YYMMDD) written into a file name."""
    tokens = F.filter(every(stem(name), DATE, 1), lambda t: F.substring(t, -4, 2).cast("int").between(1, 12) & F.substring(t, -2, 2).cast("int").between(1, 31))
    last = F.try_element_at(tokens, F.lit(-1))
    return F.when(F.length(last) >= 6, F.substring(last, -6, 6)).otherwise(last)


def series_key(name: Column, number: Column) -> Column:
    """Key shared by the revisions of a drawing: its sheet number, else its title without dates and copy marks."""
    own = F.regexp_replace(stem(name), DATE, "")
    for _ in range(3):
        own = F.regexp_replace(own, COPY, "")
    title = F.lower(F.regexp_replace(own, r"[\s_\-()\[\].]+", ""))
    return F.when(number.isNull() | (number == ""), F.concat(F.lit("t:"), title)).otherwise(F.concat(F.lit("no:"), F.replace(F.upper(number), F.lit(" "), F.lit(""))))


def slug(text: Column) -> Column:
    """Readable key: no #, separators as single dashes, lower case; `unknown` if nothing is left."""
    own = F.trim(F.regexp_replace(F.trim(text), r"^#+|#+$", ""))
    own = F.regexp_replace(F.regexp_replace(own, r"[\s,_/\\]+", "-"), "-{2,}", "-")
    own = F.lower(F.btrim(own, F.lit("-")))
    return F.when(own == "", "unknown").otherwise(F.coalesce(own, F.lit("unknown")))


@F.pandas_udf(T.StringType())
def nfc_folded(text: pd.Series) -> pd.Series:
    """NFC and case folding, for scripts where lower case is not enough."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


def is_english(text: Column) -> Column:
    return ~text.rlike("[가-힣]") & (F.regexp_count(text, F.lit("[A-Za-z]")) >= 3)


def final_consonant(text: Column) -> Column:
    """Whether a Korean word ends in a consonant, by the code point of its last syllable; null for others."""
    code = F.ascii(F.substring(text, -1, 1))
    return F.when(code.between(44032, 55203), (code - 44032) % 28 > 0)


def particle(text: Column, after_consonant: str, after_vowel: str) -> Column:
    return F.concat(text, F.when(final_consonant(text), after_consonant).otherwise(after_vowel))


def version_parts(text: Column) -> Column:
    return F.transform(every(text, r"\d+"), lambda n: n.cast("int"))


def scale_denominator(text: Column) -> Column:
    return F.regexp_extract(text, r"1\s*[/:]\s*(\d+)", 1).try_cast("int")


UNIT_SCALE = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "inch": 25.4, "foot": 304.8}


def unit_scale(unit: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in UNIT_SCALE.items() for x in kv])[F.lower(unit)]


def bbox_of(text: Column) -> Column:
    """'x,y,X,Y' as a box with its corners in order; null unless four numbers."""
    n = F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
    box = F.struct(F.least(n[0], n[2]).alias("min_x"), F.least(n[1], n[3]).alias("min_y"), F.greatest(n[0], n[2]).alias("max_x"), F.greatest(n[1], n[3]).alias("max_y"))
    return F.when((F.size(n) == 4) & ~F.exists(n, lambda x: x.isNull()), box)


def like_literal(text: Column, term: str) -> Column:
    """Case-insensitive containment where %, _ and \\ are themselves."""
    return F.contains(F.lower(text), F.lit(term.lower()))


def wildcard(text: Column, pattern: str) -> Column:
    """Match with * and ?, or case-insensitive equality without them."""
    if "*" in pattern or "?" in pattern:
        return F.ilike(text, F.lit(pattern.replace("*", "%").replace("?", "_")))
    return F.lower(text) == pattern.lower()


def bounded_join(items: Column, separator: str, most: int) -> Column:
    """Items joined until the next would exceed a number of characters."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(done, item):
        text = F.when(done["text"] == "", item).otherwise(F.concat(done["text"], F.lit(separator), item))
        fits = ~done["full"] & (F.length(text) <= most)
        return F.struct(F.when(fits, text).otherwise(done["text"]).alias("text"), (~fits).alias("full"))

    return F.aggregate(items, start, add, lambda done: done["text"])


SHEET = r"^([A-Z]{1,3}-?\d{2,4}(?:-\d{1,3})?|(?:소방|통신|토목|전기|기계|건축|구조)-?\d{1,4}(?:-\d{1,3})?)(?![A-Z0-9가-힣])"


def sheet_fields(name: Column) -> Column:
    """struct(number, title) of a drawing's file name: an order prefix is ignored, the number must come first, a range keeps its first."""
    own = F.trim(F.regexp_replace(F.trim(stem(name)), r"^(?:\d{1,3}[_.]\s*|\d{1,3}\s+-\s+(?=[A-Za-z가-힣]{1,3}-?\d))", ""))
    number = F.regexp_extract(F.upper(own), SHEET, 1)
    rest = F.regexp_replace(F.substring(own, F.length(number) + 1, F.length(own)), r"^\s*~\s*[A-Za-z가-힣]{0,3}-?\d{1,4}", "")
    title = F.when(number == "", F.btrim(own, F.lit(" -_[]"))).otherwise(F.trim(F.regexp_replace(rest, r"[_\s\-\[\]]+", " ")))
    return F.struct(F.nullif(number, F.lit("")).alias("number"), F.nullif(title, F.lit("")).alias("title"))


ROOM = r"(?i)^\s*(?:(\d{1,4}[A-Z]?)\s*호?\s+)?([^\d\s(][^\d(]{0,30}?(?:\s?\d{1,2})?)\s*(?:[(\[]?\s*(\d{1,5}(?:[.,]\d{1,3})?)\s*(?:㎡|m2|m²|sqm)\s*[)\]]?)?\s*$"


def room_label(value: Column) -> Column:
    """struct(number, name, area) of a room label of up to three lines; null for other text."""
    lines = F.filter(F.transform(F.split(value, r"[\r\n]+|\\P"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.try_element_at(lines, F.lit(1))
    part = lambda g: F.nullif(F.regexp_extract(head, ROOM, g), F.lit(""))
    below = F.regexp_extract(F.array_join(F.slice(lines, 2, 2), " "), r"(?i)(\d{1,5}(?:[.,]\d{1,3})?)\s*(?:㎡|m2|m²|sqm)", 1)
    area = F.coalesce(part(3), F.nullif(below, F.lit("")))
    fits = F.size(lines).between(1, 3) & (F.length(head) <= 40) & head.rlike(ROOM)
    return F.when(fits, F.struct(part(1).alias("number"), part(2).alias("name"), F.replace(area, F.lit(","), F.lit(".")).try_cast("double").alias("area")))


#: Folder names that group projects, and phases of a project; fixed values.
CONTAINERS = ["프로젝트", "감리", "공모", "현상", "작업중", "웹하드", "회사", "projects", "project"]
PHASES = ["허가", "사용승인", "실시", "착공", "기본", "계획", "설계", "변경", "준공", "실시설계", "기본설계", "계획설계", "인허가", "건축허가", "공사", "시공", "견적", "심의", "구조", "전기", "기계", "소방", "토목", "조경", "통신", "설비", "도면", "서류", "참고", "자료"]


def project(folder: Column) -> Column:
    """struct(key, name, phase) of a folder path: its last level, or the one above a phase folder, or a level marked ##."""
    parts = F.filter(F.split(folder, r"[\\/]+"), lambda p: F.trim(p) != "")
    clean = lambda c: F.trim(F.regexp_replace(F.trim(c), "^#+", ""))
    at = lambda k: F.try_element_at(parts, F.lit(k))
    phase = lambda c: F.exists(F.array(*map(F.lit, PHASES)), lambda w: F.startswith(clean(c), w) & (F.length(clean(c)) <= F.length(w) + 3))
    container = lambda c: F.lower(clean(c)).isin(CONTAINERS) | (F.startswith(c, F.lit("###")) & (F.length(clean(c)) <= 6))
    marked = F.startswith(at(1), F.lit("##")) & ~F.startswith(at(1), F.lit("###"))
    under = (F.size(parts) >= 2) & F.coalesce(phase(at(-1)), F.lit(False)) & ~F.coalesce(container(at(-2)), F.lit(False))
    name = clean(F.when(marked, at(1)).when(under, at(-2)).otherwise(at(-1)))
    stage = F.when(marked, F.when((F.size(parts) >= 2) & phase(at(2)), clean(at(2)))).when(under, clean(at(-1)))
    return F.struct(slug(name).alias("key"), name.alias("name"), F.coalesce(stage, F.lit("")).alias("phase"))


def whole_word(body: Column, word: str) -> Column:
    """Containment; a word of two Hangul syllables or fewer only as a token, alone or before a particle."""
    import re

    if len(word) > 2 or not re.fullmatch("[가-힣]+", word):
        return like_literal(body, word)
    return body.rlike(f"(?:^|[^가-힣A-Za-z0-9]){word}(?:은|는|이|가|을|를|의|에|와|과|도|만|로|으로)?(?=$|[^가-힣A-Za-z0-9])")


def relevance_terms(title: Column, most: int = 8) -> Column:
    """Terms of a title: punctuation out but for decimal points, the first `most`."""
    own = F.regexp_replace(title, r"(?<!\d)\.|\.(?!\d)|[^0-9A-Za-z가-힣.\s]", " ")
    return F.slice(F.filter(F.split(own, r"\s+"), lambda w: w != ""), 1, most)


def sheet_storey(title: Column, category: Column) -> Column:
    """Storey of a plan or structural plan from its title."""
    return F.when(category.isin("plan", "structural_plan"), storey_from(title))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
