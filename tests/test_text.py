"""Text functions on single values, cases beside the tables."""

import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import claims as cm
from sparkloom.functions import text as tx


@pytest.fixture(scope="module")
def value(spark):
    def of(f, *texts):
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        return df.select(f(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first().v

    return of


def test_keys_ignore_space_and_punctuation(value):
    assert value(tx.normalized_key, " 机器·学习（ML）_A ") == "机器学习mla"
    assert value(tx.narrow_key, "a [b] - c") == "a[b]c"
    assert value(tx.prose, "--Hello,  Wörld!!") == "hello wörld"


@pytest.mark.parametrize(
    ("text", "status"),
    [("", "rejected"), ("12", "rejected"), ("第 3 页", "rejected"), ("F = ma", "uncovered"), ("∫ f dx", "uncovered"), ("?!—", "rejected"), ("x y z", "deferred"), ("单选题\nA\nB\n", "deferred"), ("A plain sentence.", "uncovered"), (" a", "deferred")],
)
def test_gates(spark, text, status):
    df = spark.createDataFrame([(text,)], "t string")
    assert tx.gates(df, "t").first().status == status


def test_label_and_definition_issues(value):
    assert value(tx.label_issues, "   ") == ["empty"]
    assert value(tx.label_issues, "a") == ["too_short"]
    assert value(tx.label_issues, "概述") == ["generic"]
    assert value(tx.label_issues, "关于力的") == ["dangling_suffix"]
    assert value(tx.label_issues, "x (y") == ["unbalanced_brackets"]
    assert value(tx.label_issues, "12 m") == ["bare_quantity"]
    assert value(tx.label_issues, "Newton's law") == []
    assert value(tx.definition_issues, "the sum a +") == ["trailing_formula_operator"]
    labels = {
        "因此得到结果": "sentence_stem", "第3章 力学": "raw_section_echo", "1901年诺贝尔物理学奖获得者": "biography_caption", "示意图": "generic_visual",
        "实验照片": "photo_caption", "左侧曲线图": "layout_visual_caption", "其中": "standalone_connective", "粒子碰": None, "粒子发生碰": "truncated_trailing_character",
        "2 × 10^3 m": "bare_quantity", "OH CH3 R H": "spaced_chemical_structure_fragment", "a <= b": "formula_label_requires_formula_role", "能量_能 关系": None,
        "本节关键要点": "generic_summary", "x [continued]": "control_marker", "所以然": None, "1.5 倍": None,
    }
    for text, code in labels.items():
        assert (code in value(tx.label_issues, text)) if code else not set(value(tx.label_issues, text)) & (set(labels.values()) - {None}), text
    assert value(lambda c: tx.label_issues(c, formula=True), "a <= b") == [] and value(lambda c: tx.label_issues(c, section=True), "第3章 力学") == []
    definitions = {
        "结果如下：": "formula_intro_without_body", "粒子从 A": "dangling_directional_symbol", "能量守恒，因此": "dangling_connective", "粒子的": "dependent_fragment", "a →": "trailing_formula_operator",
        "基态 < 激发状态": None, "低能状态 E < 高能状态可达到": "glued_state_comparison", "可达到一倍后可达": "duplicated_predicate_glue", "好 电子: 3": "layout_number_glue", "第 3 章完": "document_footer_glue", "称为粒子的": None,
        "a sensor": None, "the motor": None, "x (y": "unbalanced_brackets",
    }
    for text, code in definitions.items():
        assert value(tx.definition_issues, text) == ([code] if code else []), text
    for text in ("x (y", "概述", "fine label", "", "12 m"):
        assert value(lambda c: tx.is_publishable(tx.strip(c)), text) == (value(tx.label_issues, text) == [])


@pytest.mark.parametrize(("text", "bad"), [("", False), ("(a[b]{c})", False), ("(a]", True), ("）（", True), ("《a（b）》", False), ("((", True), ("([)]", True)])
def test_brackets(value, text, bad):
    assert value(tx.unbalanced_brackets, text) is bad


def test_similarity_and_conflicts(value):
    assert value(tx.label_similarity, "abc", "xabcx") == 1.0 and value(tx.label_similarity, "", "a") == 0.0
    assert value(tx.label_similarity, "abcd", "bcde") == 0.5
    conflict = lambda a, b: tx.numeric_conflict(tx.numeric_claims(a), tx.numeric_claims(b))
    assert value(conflict, "is 3", "is 4") and not value(conflict, "is 3", "none") and not value(conflict, "3 and 4", "4 and 5")
    latin = lambda a, b: tx.opposite_terms(a, b, tx.LATIN_OPPOSITES)
    assert value(latin, "values increase here", "values decrease here") and not value(latin, "increase and decrease", "decrease")
    assert value(tx.opposite_terms, "压强升高", "压强降低") and not value(tx.opposite_terms, "正电荷", "负电荷")
    turned = lambda a, b: tx.reversed_causality(tx.causal_edges(a, tx.LATIN_CAUSAL), tx.causal_edges(b, tx.LATIN_CAUSAL))
    chinese = lambda a, b: tx.reversed_causality(tx.causal_edges(a), tx.causal_edges(b))
    assert value(chinese, "温度促进反应", "反应促进温度") and not value(chinese, "温度抑制反应", "温度抑制反应")
    assert value(turned, "heat causes motion", "motion causes heat") and not value(turned, "heat causes motion", "heat causes light")


def test_phrases(value):
    assert value(lambda c: tx.snippet(c, "NEEDLE", 5), "some words around needle and more") == "…ound needle and …"
    assert value(lambda c: tx.highlight(c, "a<b"), "x A<B y") == "x <mark>A&lt;B</mark> y"
    assert value(tx.humanize_cron, "0 */2 * * *") == "every 2 hours" and value(tx.humanize_cron, "5 9 * * 1-5") == "weekdays at 09:05"
    assert value(tx.humanize_cron, "not a cron") == "not a cron"
    assert value(lambda c: tx.format_tokens(c.cast("long")), "1048576") == "1M" and value(lambda c: tx.format_tokens(c.cast("long")), "1536") == "1.5k"
    for n in (1023, 1024, 1075, 1076, 1126, 1127, 1536, 102399, 102400, 1048575, 1048576, 1572864, 1625293):
        k, m = n / 1024, n / 1048576
        short = lambda v: str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)).removesuffix(".0")
        assert value(lambda c: tx.format_tokens(c.cast("long")), str(n)) == (short(m) + "M" if m >= 1 else str(math.floor(k + 0.5)) + "k" if k >= 100 else short(k) + "k" if k >= 1 else str(n))
    for n in (999, 1000, 1050, 1150, 1250, 1350, 1450, 59949, 59950, 60000, 61150, 61250, 3599999):
        second = lambda ms: str(Decimal(ms / 1000).quantize(Decimal("0.1"), ROUND_HALF_UP)) + "s"
        assert value(lambda c: tx.format_duration(c.cast("long")), str(n)) == (f"{n}ms" if n < 1000 else second(n) if n < 60000 else f"{n // 60000}m" + second(n % 60000))
    assert value(tx.clean_name, "- 3 items") == "3 items" and value(tx.clean_name, "三、力学  基础") == "力学 基础"
    assert value(tx.infer_heading, "第 3 章 力学\nabc") == "chapter 3 力学" and value(tx.infer_heading, "§ 1.2 Waves") == "§1.2 Waves" and value(tx.infer_heading, "plain") is None
    assert value(tx.outer_json, 'Sure: {"a": 1} ok') == '{"a": 1}' and value(tx.outer_json, "none") is None
    assert value(tx.reflow, "exam-\nple text\nand more.\nNext\n- item\n\npara") == "example text and more.\nNext\n- item\n\npara"
    assert value(lambda c: tx.wrap_label(c, 4.0, 2), "abcdefghijklmnopqrstuvwxyz") == ["abcdefg", "hijklmn…"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("F = m*a", "m*a = F", True), ("F=ma", "a*m=F", False), ("E = m*c²", "m = E/c^2", True), ("E = m*c^2", "E = m*c^3", False), ("2*x = 4*y", "x = 2y", True), ("a/b = c", "a = b*c", True), ("x < y", "y < x", False), ("0.5*m*v^2 = E", "m*v^2/2 = E", True)],
)
def test_equal_formulas_have_equal_keys(a, b, same):
    assert cm.formula_key(a) and cm.formula_key(b)
    assert (cm.formula_key(a) == cm.formula_key(b)) is same


def test_claims():
    assert cm.formula_key("no relation") is None and cm.formula_key("x = sin(") is None and cm.formula_key("a = 0") is None
    assert cm.canonical("x²⁺ + H₂O") == "x^2++h_2o" and cm.claim_key("Ｈello, Wörld-1") == "hellowörld1"
    assert cm.evidence_key("exam-\nple te­xt") == "exampletext"
    assert cm.anchors("brownish anchors", "brown, reanchored 1234") == ["anchor", "brown"]
    assert cm.anchors("quick brown", "quick brown") == ["brown"] and cm.anchors("1234", "1234") == []
    assert [i[0] for i in cm.fidelity_issues("v = 3*u and 42", ["v = 2*u"])] == ["unsupported_relation", "unsupported_number"]
    assert cm.fidelity_issues("m*a = F", ["F = m*a holds"]) == []
    assert cm.fidelity_issues("speed < limit", ["limit < speed"])[0][0] == "conflicting_relation"
