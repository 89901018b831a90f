"""Text functions and gates as columns. Patterns are parameters; the fixed values below are the defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that name keys ignore, in the wide and the narrow form.
KEY_CLASS = r"[\s·•,，。；;:：()（）【】\[\]{}《》<>_-]+"
NARROW_KEY_CLASS = r"[\s·•,，。；;:：()（）_-]+"
#: Brackets that must pair up.
BRACKETS = (("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"), ("{", "}"), ("《", "》"))
#: Characters of a word in the gates, private-use glyphs, relation signs.
WORD_CHAR = r"[\p{L}\p{N}_㐀-鿿]"
PRIVATE = r"[-�]"
RELATION = r"[=≈≃≅≤≥<>]"
PAGE_NUMBER = r"(?i)^(?:第\s*)?\d{1,4}(?:\s*页)?$"


@dataclass(frozen=True)
class Rules:
    """Patterns of one language for roles and importance; the first role that matches wins."""

    roles: tuple[tuple[str, str], ...]
    formula: str
    keyword: str


#: Fixed values.
COURSE = Rules(
    roles=(("definition", "(是指|定义为|称为|即)"), ("step", "(步骤|首先|然后|最后|流程)"), ("principle", "(公式|方程|定理|原理)"), ("example", "(例如|示例|案例)"), ("warning", "(注意|警告|避免|禁止)")),
    formula="[=≈∑Σ∫]",
    keyword="(定义|原理|方法|步骤|公式|结论|注意)",
)
#: The same for text in Latin letters.
LATIN = Rules(
    roles=(("definition", "(?i)(is the|are the|is a )"), ("step", "(?i)(first|then|finally)"), ("principle", "(?i)(rule|law|that)"), ("example", "(?i)(for example|such as)"), ("warning", "(?i)(note|never|avoid)")),
    formula="[=|]",
    keyword="(?i)(tion|rule|method|step)",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", "")


def normalized_key(c: Column) -> Column:
    """A name without white space and punctuation, in lower case."""
    return F.lower(F.regexp_replace(c, KEY_CLASS, ""))


def narrow_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, NARROW_KEY_CLASS, ""))


def prose(c: Column, separator: str = " ") -> Column:
    """Letters and digits in lower case, every other run as one separator, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", separator))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def without_page_markers(c: Column) -> Column:
    """Lines trimmed; blank ones and bare page numbers dropped."""
    lines = F.transform(F.split(F.regexp_replace(c, r"\r\n|\r", "\n"), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_NUMBER)), "\n")


def _formula(s: Column) -> Column:
    left, right = F.regexp_replace(s, f"(?s){RELATION}.*$", ""), F.regexp_replace(s, f"(?s)^.*?{RELATION}", "")
    signs = s.rlike("[∫∑Σ√]") & (F.regexp_count(s, F.lit(WORD_CHAR)) >= 3)
    return F.when(s.rlike(RELATION), left.rlike(WORD_CHAR) & right.rlike(WORD_CHAR)).otherwise(signs)


def is_formula(c: Column) -> Column:
    """A relation with something on both sides, or a sum, integral or root over three characters."""
    return _formula(without_space(without_page_markers(c)))


def is_glyph_noise(c: Column) -> Column:
    s = without_space(without_page_markers(c))
    n = F.regexp_count(s, F.lit(PRIVATE))
    return (n >= 4) & (n >= 0.15 * F.length(s))


def is_bare_quiz(c: Column, marker: str = "(?:单选题|多选题|判断题|选择题|提交|查看答案)") -> Column:
    """A quiz marker with two option letters or more, none of which has a text."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(c, r"\r\n|\r", "\n"), "\n"), strip), lambda x: x != "")
    bare = F.size(F.filter(lines, lambda x: x.rlike(r"(?i)^[A-HＡ-Ｈ][、.)）:]?$")))
    loose = F.regexp_count(c, F.lit(r"(?i)(?:^|\s)[A-HＡ-Ｈ](?=\s|$)"))
    full = F.size(F.filter(lines, lambda x: x.rlike(r"(?i)^[A-HＡ-Ｈ](?:[、.)）:]\s*|\s+)\S+")))
    return c.rlike(marker) & (F.when(bare >= 2, bare).otherwise(loose) >= 2) & (full == 0)


#: Names of axes.
AXES = ("x", "y", "z", "r", "t", "o", "θ", "φ", "ϕ", "ρ", "ψ")


def _axis_fragment(body: Column, formula: Column) -> Column:
    tokens = F.transform(F.regexp_extract_all(body, F.lit(r"[A-Za-z]+|[Α-ω]+|[㐀-鿿]+"), F.lit(0)), F.lower)
    n, kinds = F.size(tokens), F.size(F.array_distinct(tokens))
    axes = (n >= 2) & F.forall(tokens, lambda t: t.isin(*AXES)) & ((n <= 3) | (kinds <= F.greatest(F.lit(2), F.floor(n / 2))))
    signs = (n == 0) & body.rlike(r"[^\p{L}\p{N}_\s]")
    return (body != "") & ~body.rlike(r"[㐀-鿿]{2,}|[A-Za-z]{3,}|[Α-ω]{2,}") & ~formula & (axes | signs)


def is_axis_fragment(c: Column) -> Column:
    """Nothing but axis names, or nothing but signs."""
    return _axis_fragment(without_page_markers(c), is_formula(c))


def gates(df: DataFrame, text: str) -> DataFrame:
    """df with status and ceiling of a text unit (the first gate that applies decides), formula and math_score. What
    the gates share is computed once, in a projection of its own."""
    c = F.col(text)
    df = df.withColumn("_body", without_page_markers(c))
    df = df.withColumn("_s", without_space(F.col("_body")))
    df = df.withColumn("formula", _formula(F.col("_s")))
    s = F.col("_s")
    n = F.regexp_count(s, F.lit(PRIVATE))
    rules = [
        (s == "", "rejected", 0.02),
        ((n >= 4) & (n >= 0.15 * F.length(s)), "deferred", 0.1),
        (F.col("formula"), "uncovered", None),
        (~s.rlike(WORD_CHAR), "rejected", 0.04),
        (is_bare_quiz(c), "deferred", 0.12),
        (_axis_fragment(F.col("_body"), F.col("formula")), "deferred", 0.1),
    ]
    gate = F.lit(len(rules))
    for i, (test, _, _) in reversed(list(enumerate(rules))):
        gate = F.when(test, i).otherwise(gate)
    df = df.withColumn("_gate", gate)
    status = F.get(F.array(*[F.lit(r[1]) for r in rules], F.lit("uncovered")), F.col("_gate"))
    ceiling = F.get(F.array(*[F.lit(r[2]).cast("double") for r in rules], F.lit(None).cast("double")), F.col("_gate"))
    return df.withColumns({"status": status, "ceiling": ceiling, "math_score": _math(F.col("_body"), s)}).drop("_body", "_s", "_gate")


def unit_role(c: Column, rules: Rules = COURSE) -> Column:
    head = F.substring(c, 1, 240)
    out = None
    for role, pattern in rules.roles:
        value = F.when(head.rlike(rules.formula), "formula").otherwise(role) if role == "principle" else F.lit(role)
        out = F.when(head.rlike(pattern), value) if out is None else out.when(head.rlike(pattern), value)
    return out.otherwise("other")


def importance(c: Column, heading: Column, rules: Rules = COURSE) -> Column:
    score = F.lit(0.42) + F.when(heading.isNotNull() & (heading != ""), 0.18).otherwise(0.0)
    score += F.when(F.substring(c, 1, 500).rlike(rules.keyword), 0.16).otherwise(0.0)
    score += F.least(F.length(c), F.lit(1800)) / 1800 * 0.12
    return F.round(F.least(score, F.lit(1.0)), 4)


def _math(body: Column, s: Column) -> Column:
    science = F.regexp_count(body, F.lit(r"(?i)\d(?:\.\d+)?\s*(?:×|x|\*)\s*10\s*(?:\^|[-−])?\s*\d+"))
    signs = F.regexp_count(s, F.lit(r"[∫∑Σ√Δλνπħ×÷^]"))
    return 8 * F.regexp_count(s, F.lit(RELATION)) + 4 * F.regexp_count(s, F.lit("/")) + 3 * science + F.least(signs, F.lit(12))


def math_score(c: Column) -> Column:
    """Relations, fractions, powers of ten and signs, weighted; not the length of text."""
    body = without_page_markers(c)
    return _math(body, without_space(body))


def is_low_quality(c: Column) -> Column:
    s = without_space(without_page_markers(c))
    n = F.greatest(F.length(s), F.lit(1))
    private, semantic = F.regexp_count(s, F.lit(PRIVATE)), F.regexp_count(s, F.lit(WORD_CHAR))
    weak = ~s.rlike(WORD_CHAR) | is_axis_fragment(c) | ((private / n >= 0.35) & (semantic / n < 0.45))
    return (s == "") | (~is_formula(c) & weak)


def infer_heading(c: Column) -> Column:
    """A chapter or section heading in the first line, else null."""
    first = F.regexp_replace(F.element_at(F.split(without_page_markers(c), "\n"), 1), r"^[*△▲•#\s]+", "")
    first = F.trim(F.regexp_replace(first, r"\s+", " "))
    chapter, section = r"^(?:第\s*|(?i:chapter)\s+)(\d+)(?:\s*章)?[\s:：.]*(.*)$", r"^(?:§\s*)?(\d+(?:\s*\.\s*\d+)+)[\s:：.]*(.*)$"
    usable = (F.length(first) <= 72) & ~first.rlike("[，、,：:]$")
    as_chapter = F.trim(F.concat(F.lit("chapter "), F.regexp_extract(first, chapter, 1), F.lit(" "), F.regexp_extract(first, chapter, 2)))
    as_section = F.trim(F.concat(F.lit("§"), without_space(F.regexp_extract(first, section, 1)), F.lit(" "), F.regexp_extract(first, section, 2)))
    return F.when(usable & first.rlike(chapter), as_chapter).when(usable & first.rlike(section), as_section)


def unbalanced_brackets(c: Column) -> Column:
    """Whether a typed stack of brackets fails: innermost pairs are removed as often as brackets can nest here."""
    some = c.rlike(r"[()（）\[\]【】{}《》]")
    only = F.when(some, F.regexp_replace(c, r"[^()（）\[\]【】{}《》]", "")).otherwise("")
    pairs = "|".join(f"\\{a}\\{b}" if a in "([{" else f"{a}{b}" for a, b in BRACKETS)
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.length(only) / 2).cast("int")), only, lambda s, _: F.regexp_replace(s, pairs, "")) != ""


#: Labels that say nothing, ends that something must follow, and words that join sentences.
GENERIC = ("本章", "概述", "总结", "课程内容", "基础知识", "核心内容", "知识点", "案例", "介绍", "补充主题", "视觉知识", "视觉内容", "图片内容", "图示内容", "关键要点")
SUFFIXES = ("即使", "但是", "因为", "由于", "通过", "对于", "关于", "以及", "的", "了", "不", "而")
CONNECTIVES = ("但是", "然而", "并且", "而且", "因此", "所以", "因为", "如果", "即使", "以及", "其中", "同时")
CONTROL_MARKERS = ("[上文衔接]", "【上文衔接】", "[continued]", "[continuation]")
#: Last characters of cut-off labels, and from which length on.
CUT_OFF = (("描", 8), ("碰", 4))
#: Patterns of labels that are no names, by issue.
SENTENCE_STEM = r"^(?:这(?:说明|表明|意味着|证明)|由此(?:可见|说明|表明|得到)|(?:可以|可)(?:看出|得到|说明|表明)|例如(?:对于)?|比如|所以(?:[^然]|$)|因此|故而|于是|由于|因为|若|如果|当|设|则|(?:提出|证明|说明|表明|发现|给出|得到|获得)了)"
SECTION_ECHO = r"^(?:[*△▲]\s*)?(?:§\s*\d|第\s*(?:\d+|[一二三四五六七八九十百]+)\s*章|[一二三四五六七八九十]+\s*[.、．]|\d{1,2}\s*(?:[、．]|\.(?:[^\d]|$)))"
BIOGRAPHY = r"(?:^|\d{4}\s*年|年)诺贝尔.{0,18}(?:奖获得者|奖得主)"
GENERIC_VISUAL = r"^(?:(?:蓝|红|黑|白|彩色|黑白)?框(?:内)?公式|对比示意图|示意图|曲线图|照片|图片|截图)$"
PHOTO = r"(?:照片|图片|截图|影像)$"
LAYOUT_VISUAL = r"^(?:并列|左右|上下|左(?:侧|图)|右(?:侧|图)|上(?:方|图)|下(?:方|图)|页面|画面|带标注).*(?:图|公式|照片|图片|截图|视场)$"
QUANTITY = r"(?i)^[~≈≃]?\s*[+\-−]?\d+(?:\.\d+)?(?:\s*(?:×|x|\*)\s*10(?:\^[+\-]?\d+|[⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))?\s*(?:Å|[fpnumμkMGT]?m|Hz|[fpnumμkMGT]?eV|J(?:/T)?|K|[fpnumμkMGT]?W|rad|sr|Pa|T|V|A|C|N|s|%)\s*$"
FORMULA_RELATION = r"(?:~=|≈|≃|==?|>=?|<=?|≥|≤|>>|<<|→|⇒|⇔)"
REACTION = r"(?:=|≈|≤|≥|→|⇒|⇌|⟶|⟷|--?>)"
LONE_ATOMS = ("r", "x", "o", "oh", "h", "n", "c", "cl", "br", "i")
CJK = "[㐀-鿿]"


def _only_formula(s: Column) -> Column:
    """A relation and no CJK character but in subscripts."""
    return s.rlike(FORMULA_RELATION) & ~F.regexp_replace(s, f"_{CJK}+", "_x").rlike(CJK)


def _structure_fragment(s: Column) -> Column:
    """Four words or more, all made of chemical elements or R and X, of which two at least are single groups."""
    words = F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0))
    odd = F.exists(words, lambda w: ~w.rlike("^(?:[A-Z][a-z]?)+$") & ~F.lower(w).isin("r", "x"))
    lone = F.size(F.filter(words, lambda w: F.lower(w).isin(*LONE_ATOMS)))
    # cheap tests first: most labels have too few blanks
    return s.rlike("[A-Za-z][^A-Za-z]+[A-Za-z]+[^A-Za-z]+[A-Za-z]+[^A-Za-z]+[A-Za-z]") & ~s.rlike(CJK) & ~s.rlike(REACTION) & ~odd & (lone >= 2)


def _label_rules(s: Column, longest: int, generic: tuple[str, ...], suffixes: tuple[str, ...], section: bool, formula: bool) -> list[tuple[Column, str]]:
    """(test, code) in the order in which codes are told. Tests on the whole label come before searches in it."""
    marked, cut = F.lit(False), F.lit(False)
    for m in CONTROL_MARKERS:
        marked = marked | F.lower(s).contains(m)
    for c, n in CUT_OFF:
        cut = cut | (s.endswith(c) & (F.length(s) >= n))
    rules = [
        (F.length(s) < 2, "too_short"),
        (F.length(s) > (160 if formula else longest), "too_long"),
        (s.rlike(r"[\n\r]"), "multiline"),
        (s.rlike(r"[\p{Cc}\p{Cf}]"), "control_character"),
        (marked, "control_marker"),
        (normalized_key(s).isin(*[g.lower() for g in generic]), "generic"),
        (s.endswith("关键要点"), "generic_summary"),
        (s.rlike(SENTENCE_STEM), "sentence_stem"),
        (F.lit(False) if section else s.rlike(SECTION_ECHO), "raw_section_echo"),
        (s.rlike(BIOGRAPHY), "biography_caption"),
        (s.rlike(GENERIC_VISUAL), "generic_visual"),
        (s.rlike(PHOTO), "photo_caption"),
        (s.rlike(LAYOUT_VISUAL), "layout_visual_caption"),
        (s.isin(*CONNECTIVES), "standalone_connective"),
        (s.startswith("的"), "dangling_prefix"),
        (s.rlike(f"(?:{'|'.join(suffixes)})$"), "dangling_suffix"),
        (cut, "truncated_trailing_character"),
        (s.rlike(r"[，,；;：:。！？!?]$"), "sentence_fragment"),
        (s.rlike(r"(?:…{1,2}|\.{3,})$"), "ellipsis"),
        (s.rlike(r"[□\ufffd]"), "placeholder_glyph"),
        (unbalanced_brackets(s), "unbalanced_brackets"),
        (s.rlike(QUANTITY), "bare_quantity"),
        (_structure_fragment(s), "spaced_chemical_structure_fragment"),
    ]
    return rules if formula else [*rules, (_only_formula(s), "formula_label_requires_formula_role")]


def label_issues(c: Column, longest: int = 48, generic: tuple[str, ...] = GENERIC, suffixes: tuple[str, ...] = SUFFIXES, section: bool = False, formula: bool = False) -> Column:
    """Codes of what makes a label unfit to publish, in the order of the rules; empty if nothing does. Roots may have 80
    characters (longest), section labels and formulas keep their numbering and their relations."""
    s = strip(c)
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in _label_rules(s, longest, generic, suffixes, section, formula)]))
    return F.when(s == "", F.array(F.lit("empty"))).otherwise(codes)


def is_publishable(stripped: Column, longest: int = 48, generic: tuple[str, ...] = GENERIC, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether a stripped label has no issue; stops at the first rule that says it has."""
    bad = stripped == ""
    for test, _ in _label_rules(stripped, longest, generic, suffixes, False, False):
        bad = bad | test
    return ~bad


#: Patterns of broken definitions, by issue.
DEFINITION_PATTERNS = {
    "formula_intro_without_body": r"(?:应有|可得|写为|表示为|关系为|公式为|分别为|如下)\s*[：:]?\s*(?:即\s*)?(?:\d{1,3})?\s*$",
    "dangling_directional_symbol": r"(?:从|由|向|到)\s*[A-Za-zΑ-ω][A-Za-zΑ-ω0-9_₀-₉]*\s*$",
    "dangling_connective": r"(?:^|[\s，,；;：:])(?:即|因此|所以|其中|分别|如下|以及|并且|而|则)\s*(?:\d{1,3})?\s*$",
    "dependent_fragment": r"^[㐀-鿿]{2,10}的[。.]?$",
    "trailing_formula_operator": r"(?:=|≈|≃|≤|≥|<|>|→|←|⇒|⇔|[+\-×÷])\s*$",
    "glued_state_comparison": r"(?:非)?[㐀-鿿]{1,12}状态\s*[A-Za-z]?\s*[<>]\s*(?:非)?[㐀-鿿]{1,12}状态\s*可(?:达到|达)",
    "duplicated_predicate_glue": r"可达到.{0,32}可达",
    "layout_number_glue": r"(?:好|坏)\s*[㐀-鿿A-Za-z-]{2,16}\s*[：:]\s*\d(?:\s|$)",
    "document_footer_glue": r"第\s*\d+\s*章\s*(?:结束|完)",
}
#: A fragment with one of these says something after all.
PREDICATES = r"(?:是|为|属于|称为|定义为|表现为)"


def definition_issues(c: Column) -> Column:
    """Codes of what makes a definition unfit to publish; none for a blank one."""
    s = F.trim(F.regexp_replace(strip(c), r"\s+", " "))
    tests = {code: s.rlike(pattern) for code, pattern in DEFINITION_PATTERNS.items()}
    tests["dependent_fragment"] = tests["dependent_fragment"] & ~s.rlike(PREDICATES)
    tests = {"placeholder_glyph": s.rlike(r"[□\ufffd]"), "unbalanced_brackets": unbalanced_brackets(s), **tests}
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(t, F.lit(code)) for code, t in tests.items()])))


def field_action(label: Column, definition: Column, label_mends: Column, definition_mends: Column, explicit: Column) -> Column:
    """What to do with a candidate whose label and definition have these issues. Whether a safe repair of either is
    there is given; a definition only counts where the candidate is `explicit` (stated in the text, no structural node)."""
    bad, worse = F.size(label) > 0, explicit & (F.size(definition) > 0)
    of_label = F.when(~label_mends, F.when(worse, "reject_entire_node").otherwise("reextract_candidate")).when(~worse, "repair_label_keep_claim")
    return (
        F.when(bad, F.coalesce(of_label, F.when(definition_mends, "repair_label_and_trim_definition_keep_claim").otherwise("reextract_candidate")))
        .when(worse, F.when(definition_mends, "trim_definition_keep_claim").otherwise("reextract_candidate"))
        .otherwise("accept")
    )


def clean_name(c: Column) -> Column:
    """Without heading, list and number prefixes; runs of blanks as one."""
    s = F.regexp_replace(c, r"^(?:\s*#+\s*|\s*[-•●▪◦‣⁃]\s*|\s*(?:\d+|[一二三四五六七八九十]+)[、.)）]\s*)", "")
    return strip(F.regexp_replace(s, r"[ \t]+", " "))


#: Marks of a continued text, and the label of what nobody can name yet.
CONTINUED = r"^\[(?:上文衔接|continued|continuation)\]\s*"
UNNAMED = "待复核课程要点"


def short_label(c: Column, fallback: Column, longest: int = 32) -> Column:
    """The first clause of the first line without marks and numbering if it is fit to publish, else the fallback, else
    the label for later review. A blank text is its fallback."""
    text, other = strip(F.coalesce(c, F.lit(""))), strip(fallback)
    first = strip(F.regexp_replace(F.element_at(F.split(F.when(text == "", other).otherwise(text), "\n"), 1), "^#+", ""))
    clause = strip(F.element_at(F.split(F.regexp_replace(first, CONTINUED, ""), "[。！？；;:：]"), 1))
    label = F.regexp_replace(clause, r"^\d+(?:\.\d+)*[\s、.)）-]*", "")
    return F.when(is_publishable(label) & (F.length(label) <= longest), label).when(is_publishable(other), other).otherwise(UNNAMED)


#: Excerpts that say nothing, relations and signs in an excerpt.
GENERIC_EXCERPTS = ("主要内容", "基本内容", "相关内容", "重要内容", "基本概念", "核心概念", "主要概念", "基本原理", "主要原理", "实验结果", "重要结论", "相关知识点", "本章内容", "如图所示", "具体如下", "定义如下")
EXCERPT_RELATION = r"(?:<=|>=|==|!=|[=<>≤≥≈→⇒∝])"
EXCERPT_SIGN = "[=<>≤≥≈+*/∫∑√-]"


def is_specific(c: Column) -> Column:
    """Whether a normalized excerpt says something of its own: three CJK characters, six letters or digits, a relation
    with two sides, or three characters and a sign; a stock phrase never does."""
    said = F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    related = c.rlike(rf"(?s)[\p{{L}}\p{{N}}].*{EXCERPT_RELATION}.*[\p{{L}}\p{{N}}]")
    return ~said.isin(*GENERIC_EXCERPTS) & ((F.regexp_count(said, F.lit(r"[㐀-鿿]")) >= 3) | (F.length(said) >= 6) | related | ((F.length(said) >= 3) & c.rlike(EXCERPT_SIGN)))


def bigrams(key: Column) -> Column:
    """The set of two-character pieces of a key; a single character is its own piece."""
    n = F.length(key)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pieces))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def label_similarity(a: Column, b: Column) -> Column:
    """1 if one key holds the other, else the Jaccard index of their bigrams; 0 for an empty key."""
    return F.when((a == "") | (b == ""), 0.0).when(a.contains(b) | b.contains(a), 1.0).otherwise(jaccard(bigrams(a), bigrams(b)))


def anchor_coverage(anchors: Column, a: Column, b: Column) -> Column:
    """Length of the shared anchors as a share of the shorter text, 1 at most."""
    least = F.least(F.length(F.replace(prose(a), F.lit(" "))), F.length(F.replace(prose(b), F.lit(" "))))
    total = F.aggregate(anchors, F.lit(0), lambda s, x: s + F.length(x))
    return F.when(least <= 0, 0.0).otherwise(F.least(F.lit(1.0), total / least))


#: Fixed values.
OPPOSITES = (("增加", "减少"), ("增大", "减小"), ("升高", "降低"), ("提高", "降低"), ("高于", "低于"), ("大于", "小于"), ("吸引", "排斥"), ("促进", "抑制"), ("正比", "反比"))
#: A set for text in English, as a parameter.
LATIN_OPPOSITES = (("increase", "decrease"), ("rise", "fall"), ("above", "below"))


def opposite_terms(a: Column, b: Column, pairs: tuple[tuple[str, str], ...] = OPPOSITES) -> Column:
    """Whether one text has the one term of a pair only and the other text the other only."""
    x, y = prose(a), prose(b)
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs])

    def only(s: Column, t: Column, u: Column, v: Column) -> Column:
        return s.contains(u) & t.contains(v) & ~s.contains(v) & ~t.contains(u)

    return F.exists(table, lambda r: only(x, y, r["p"], r["q"]) | only(x, y, r["q"], r["p"]))


#: Fixed values.
CAUSAL = ("导致", "引起", "造成", "使得", "促进", "抑制")
#: A set for text in English, as a parameter.
LATIN_CAUSAL = (" causes ", " leads to ")
#: What ends a sentence with a cause.
CAUSAL_END = r"[。！？!?；;，,\n]+"


def causal_edges(c: Column, markers: tuple[str, ...] = CAUSAL) -> Column:
    """array(struct(cause, effect)): what stands before and after a marker, 24 characters of each at most."""
    sentences = F.split(F.lower(c), CAUSAL_END)
    found = []
    for m in markers:
        found.append(F.transform(F.filter(sentences, _contains(m)), _edge(m)))
    return F.filter(F.flatten(F.array(*found)), lambda e: (F.length(e["cause"]) >= 2) & (F.length(e["effect"]) >= 2))


def _contains(m: str):
    return lambda s: s.contains(m)


def _edge(m: str):
    def edge(s: Column) -> Column:
        at = F.locate(m, s)
        cause = F.replace(prose(F.substring(s, F.lit(1), at - 1)), F.lit(" "))
        effect = F.replace(prose(F.substring(s, at + len(m), F.length(s))), F.lit(" "))
        return F.struct(F.right(cause, F.lit(24)).alias("cause"), F.left(effect, F.lit(24)).alias("effect"))

    return edge


def reversed_causality(a: Column, b: Column) -> Column:
    """Whether two arrays of causal edges hold one edge in both directions."""

    def same(x: Column, y: Column) -> Column:
        return (x == y) | ((F.length(x) >= 4) & y.contains(x)) | ((F.length(y) >= 4) & x.contains(y))

    return F.exists(a, lambda x: F.exists(b, lambda y: same(x["cause"], y["effect"]) & same(x["effect"], y["cause"])))


def numeric_claims(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"[+\-]?\d+(?:\.\d+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.ltrim(x, F.lit("+")))))


def numeric_conflict(a: Column, b: Column) -> Column:
    """Two non-empty sets of numbers that share none, or two different single ones."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b) & (~F.arrays_overlap(a, b) | ((F.size(a) == 1) & (F.size(b) == 1)))


def unsupported_numbers(definition: Column, evidence: Column) -> Column:
    """Numbers of a definition that no evidence text has."""
    return F.array_except(numeric_claims(definition), numeric_claims(F.array_join(evidence, " ")))


def outer_json(c: Column) -> Column:
    """The JSON object in a model's answer: the text without code fences, or its outermost braces."""
    s = F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.when(F.try_parse_json(s).isNotNull(), s), F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def snippet(c: Column, query: str, radius: int = 40) -> Column:
    """Text around the first hit, with an ellipsis where it was cut."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    head = F.when(F.length(flat) <= 2 * radius, flat).otherwise(F.concat(F.substring(flat, 1, 2 * radius), F.lit("…")))
    at = F.locate(query.strip().lower(), F.lower(flat)) - 1
    a, b = F.greatest(at - radius, F.lit(0)), F.least(F.length(flat), at + len(query.strip()) + radius)
    cut = F.concat(F.when(a > 0, "…").otherwise(""), F.substring(flat, a + 1, b - a), F.when(b < F.length(flat), "…").otherwise(""))
    return head if not query.strip() else F.when(at < 0, head).otherwise(cut)


#: HTML escapes.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def highlight(c: Column, query: str) -> Column:
    """HTML-escaped text with every hit marked."""
    s, q = c, query.strip()
    for a, b in ESCAPES:
        s, q = F.replace(s, F.lit(a), F.lit(b)), q.replace(a, b)
    return s if not q else F.regexp_replace(s, f"(?i)({re.escape(q)})", "<mark>$1</mark>")


def _tenths_text(t: Column, trim: bool) -> Column:
    rest = F.concat(F.lit("."), F.pmod(t, F.lit(10)).cast("string"))
    return F.concat(F.floor(t / 10).cast("string"), F.when(F.pmod(t, F.lit(10)) == 0, F.lit("")).otherwise(rest) if trim else rest)


def format_tokens(n: Column) -> Column:
    """A number of tokens in units of 1024, halves up; in whole numbers, so that no fraction is lost."""
    k, m = 1024, 1024 * 1024
    return (
        F.when(n >= m, F.concat(_tenths_text(F.floor((20 * n + m) / (2 * m)), True), F.lit("M")))
        .when(n >= 100 * k, F.concat(F.floor((2 * n + k) / (2 * k)).cast("string"), F.lit("k")))
        .when(n >= k, F.concat(_tenths_text(F.floor((20 * n + k) / (2 * k)), True), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def _second_tenths(ms: Column) -> Column:
    """Tenths of a second by the exact value of the double ms / 1000: what lies just below a half goes down."""
    x = ms / 1000.0
    high = F.floor(x * 2.0**20) / 2.0**20
    above = (high * 1000.0 - ms) + (x - high) * 1000.0  # exact, both products have few bits
    rest = F.pmod(ms, F.lit(100))
    return F.floor(ms / 100) + F.when((rest > 50) | ((rest == 50) & (above >= 0)), 1).otherwise(0)


def format_duration(ms: Column) -> Column:
    """Whole milliseconds, seconds with a tenth, or minutes and seconds."""
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(_tenths_text(_second_tenths(ms), False), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60000).cast("string"), F.lit("m"), _tenths_text(_second_tenths(F.pmod(ms, F.lit(60000))), False), F.lit("s")))
    )


def humanize_cron(c: Column) -> Column:
    """A phrase for six shapes of five-field expressions; others stay as they are."""
    f = F.split(F.trim(c), r"\s+")
    m, h, rest = f[0], f[1], F.array_join(F.slice(f, 3, 3), " ")
    clock = F.concat(F.lpad(h, 2, "0"), F.lit(":"), F.lpad(m, 2, "0"))
    n_min, n_hour = F.regexp_extract(m, r"^\*/(\d+)$", 1), F.regexp_extract(h, r"^\*/(\d+)$", 1)
    timed = m.rlike(r"^\d+$") & h.rlike(r"^\d+$")
    out = (
        F.when((m == "*") & (h == "*") & (rest == "* * *"), "every minute")
        .when((n_min == "1") & (h == "*") & (rest == "* * *"), "every minute")
        .when((n_min != "") & (h == "*") & (rest == "* * *"), F.concat(F.lit("every "), n_min, F.lit(" minutes")))
        .when((m == "0") & (h == "*") & (rest == "* * *"), "every hour")
        .when((m == "0") & (n_hour != "") & (rest == "* * *"), F.concat(F.lit("every "), n_hour, F.lit(" hours")))
        .when(timed & (rest == "* * 1-5"), F.concat(F.lit("weekdays at "), clock))
        .when(timed & (rest == "* * *"), F.concat(F.lit("daily at "), clock))
    )
    return F.when(F.size(f) == 5, F.coalesce(out, c)).otherwise(c)


def slug(c: Column, longest: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", ""), 1, longest)


def reflow(c: Column) -> Column:
    """Wrapped lines joined: hyphenated Latin ones without the hyphen, CJK ones without a blank, others with one;
    list items and ends of sentences break."""
    lines = F.transform(F.split(F.regexp_replace(c, r"\r\n|\r", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"[ \t]+", " ")))

    def fold(s: Column, x: Column) -> Column:
        fresh = (s == "") | s.endswith("\n")
        item = r"^(?:[-•●▪◦‣⁃*]|\d+[、.)）])"
        last_item = F.element_at(F.split(s, "\n"), -1).rlike(item)
        joined = F.when(s.rlike(r"[A-Za-z]-$") & x.rlike("^[a-z]"), F.concat(F.regexp_replace(s, "-$", ""), x)).when(s.rlike(r"[㐀-鿿]$") & x.rlike(r"^[㐀-鿿]"), F.concat(s, x)).otherwise(F.concat(s, F.lit(" "), x))
        return F.when(x == "", F.when(fresh, s).otherwise(F.concat(s, F.lit("\n\n")))).when(fresh, F.concat(s, x)).when(x.rlike(item) | s.rlike(r"[。！？.!?；;]$") | last_item, F.concat(s, F.lit("\n"), x)).otherwise(joined)

    return F.regexp_replace(F.aggregate(lines, F.lit(""), fold), r"\s+$", "")


def wrap_label(c: Column, width: float = 8.0, lines: int = 2) -> Column:
    """Greedy wrap by character units (ASCII .55, others 1) into an array of lines; an ellipsis where text is left."""

    def fold(s: Column, ch: Column) -> Column:
        unit = F.when(ch.rlike(r"^[\x00-\x7f]$"), 0.55).otherwise(1.0)
        over = s["used"] + unit > width
        return F.struct(
            F.when(over, F.array_append(s["lines"], s["now"])).otherwise(s["lines"]).alias("lines"),
            F.when(over, ch).otherwise(F.concat(s["now"], ch)).alias("now"),
            F.when(over, unit).otherwise(s["used"] + unit).alias("used"),
        )

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"), F.lit(0.0).alias("used"))
    done = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, fold)
    every = F.filter(F.array_append(done["lines"], done["now"]), lambda x: x != "")
    cut = F.slice(every, 1, lines)
    return F.when(F.size(every) <= lines, every).otherwise(F.concat(F.slice(every, 1, lines - 1), F.array(F.concat(F.element_at(cut, -1), F.lit("…")))))


def latex_canonical(c: Column) -> Column:
    """Formula text for scoring: LaTeX commands as plain signs, no brackets, spaces or punctuation, lower case."""
    s = c
    for pattern, plain in ((r"\\(?:dfrac|tfrac|frac)\{([^{}]*)\}\{([^{}]*)\}", "$1/$2"), (r"\\(?:times|cdot)", "*"), (r"\\leq?", "<="), (r"\\geq?", ">="), (r"\\approx", "≈"), (r"\\(?:left|right|mathrm|mathbf|text|operatorname)", ""), (r"\\([A-Za-z]+)", "$1"), (r"[\s{}()\[\],;.$~]+", "")):
        s = F.regexp_replace(s, pattern, plain)
    return F.lower(s)


def repaired_definition(c: Column) -> Column:
    """A definition cut before its first broken place to the last whole sentence, if that has no issue; else null."""
    cut = F.regexp_replace(c, r"(?s)[□�].*$|(?:应有|可得|写为|表示为|如下)\s*[：:]?\s*$", "")
    whole = strip(F.regexp_extract(cut, r"(?s)^(.*[。！？.!?])", 1))
    return F.when(F.size(definition_issues(c)) == 0, c).when((whole != "") & (F.size(definition_issues(whole)) == 0), whole)


def swarm_counts(c: Column) -> Column:
    """struct(completed, failed, rows) of a tagged result; tags inside a result are text."""
    flat = F.regexp_replace(c, r"(?s)<result>.*?</result>", "")
    return F.struct(F.regexp_count(flat, F.lit(r'<task[^>]*status="completed"')).alias("completed"), F.regexp_count(flat, F.lit(r'<task[^>]*status="failed"')).alias("failed"), F.regexp_count(flat, F.lit("<task[ >]")).alias("rows"))


def context_used(live: Column, manifest: Column, ratio: Column, limit: Column, fallback: Column) -> Column:
    """Tokens in context: the live figure, the manifest's, the ratio of the limit, or the fallback."""
    return F.coalesce(live, manifest, F.when(ratio.isNotNull() & limit.isNotNull(), F.round(ratio * limit).cast("long")), fallback)


def turn_markdown(blocks: Column) -> Column:
    """Typed blocks (type, text) of a turn as one text: tools as code, thoughts as quotes."""
    return F.array_join(F.transform(blocks, lambda b: F.when(b["type"] == "tool", F.concat(F.lit("```\n"), b["text"], F.lit("\n```"))).when(b["type"] == "thinking", F.concat(F.lit("> "), F.replace(b["text"], F.lit("\n"), F.lit("\n> ")))).otherwise(b["text"])), "\n\n")
