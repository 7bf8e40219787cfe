"""Fitting into slots: samples of each rule, and a brute force that scans breaks one token at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from unitflow.operators import fitting
from unitflow.operators.fitting import CLOSING, OPENING, Rule

LABEL, CONTROL = r"^[【〖〔《〈［\[]([^】〗〕》〉］\]\r\n]+)[】〗〕》〉］\]]", r"\\{2}|\\[A-Za-z]+\[[^\]\r\n]*\]|\\[A-Za-z]"
GAME = Rule(LABEL, CONTROL, 44)
BODY = "「这是一段超过消息窗口宽度的台词，用来确认写回只会重排正文槽。」"


def fit(lines, original, n, *rules, domain="dialogue"):
    return fitting.fit_one(domain, original, lines, n, fitting.ordered(list(rules)))[0]


@pytest.mark.parametrize("a, b", ["【】", "〖〗", "〔〕", "《》", "〈〉", "［］", "[]"])
def test_labels_keep_the_first_slot(a, b):
    got = fit([f"{a}拉吉{b}{BODY}"], [f"{a}ラージ{b}", "こんにちは。"], 2, GAME)
    assert got == [f"{a}拉吉{b}", BODY] == fit(got, [f"{a}ラージ{b}", "こんにちは。"], 2, GAME)


def test_controls_and_labels():
    one = fit([r"\C[2]【拉吉】\C[0]「你好，这是一段很长的正文。」"], [r"\C[2]【ラージ】\C[0]", "こ"], 2, GAME)
    assert one == ["【拉吉】", r"\C[2]\C[0]「你好，这是一段很长的正文。」"]
    assert fit([r"\SE[magao]【拉吉】", "「你好。」"], ["【ラージ】", "こ"], 2, GAME) == ["【拉吉】", r"\SE[magao]「你好。」"]
    assert fit(["「你好。」"], ["【ラージ】", "こ"], 2, GAME) == ["【ラージ】", "「你好。」"]
    two = fit(["【拉吉】「这是一段非常长的台词需要重新排版而不能把名字标签拆开。」", "第二行。"], ["【ラージ】「とても長い」", "二"], 2, GAME)
    assert two[0].startswith("【拉吉】") and "".join(two) == "【拉吉】「这是一段非常长的台词需要重新排版而不能把名字标签拆开。」第二行。"
    for text in ("「拉吉」", "【】", "【  】", "【a\nb】", "【a【b】", "【拉吉", "普通文本"):
        assert fitting.probe([GAME], text) is None
    assert fitting.probe([GAME], r" \C[2]【拉吉】\C[0] ")[1:] == (" \\C[2]", "【拉吉】", "\\C[0] ")


def test_rules_are_ordered_and_checked():
    rules = [Rule(width=30), Rule(width=50), Rule(width=10, domain="scroll"), Rule("^「[^」]+」", layer=2, domain="dialogue")]
    assert [r.width for r in fitting.ordered(rules)] == [0, 10, 50, 30]
    assert fitting.effective_width(rules) == 10 and fitting.effective_width(rules, "dialogue") == 50
    spoken = Rule("^「[^」]+」", domain="dialogue")
    assert fit(["「拉吉」「你好。」"], ["「ラージ」", "こ"], 2, spoken) == ["「拉吉」", "「你好。」"]
    assert fit(["「拉吉」「你好。」"], ["「ラージ」", "こ"], 2, spoken, domain="scroll") == ["「拉吉」「你好。」"]
    for pattern in ("^$", "x*"):
        with pytest.raises(ValueError):
            Rule(pattern)


def test_breaks():
    narrow = Rule(width=12)
    assert fit(["alpha beta gamma delta"], [], 2, narrow) == ["alpha beta ", "gamma delta"]
    assert fit(["甲。乙，丙丁戊己"], [], 2, narrow) == ["甲。乙，", "丙丁戊己"]
    assert fit(["甲乙「丙丁戊己"], [], 2, Rule(width=4)) == ["甲乙", "「丙丁戊己"]
    assert fit(["短い一行。", "もう一行。", "三行目。"], [], 3, GAME) == ["短い一行。", "もう一行。", "三行目。"]
    assert fit(["a", "b", "c"], [], 2, Rule()) == ["a", "bc"] and fit(["a"], [], 3, Rule()) == ["a", "", ""]
    out = fit(["\\C[27]你好世界，这是一段比较长的测试文本用来检查控制符。"], [], 2, Rule(LABEL, CONTROL, 20))
    assert any("\\C[27]" in x for x in out)


def brute_reflow(text, n, width, label, control):
    """The same breaks, found by trying each place from the widest down."""
    text = text.replace("\n", "")
    tokens, at = [], 0
    while at < len(text):
        m = re.compile(control).match(text, at) if control else None
        end = m.end() if m and m[0] else at + 1
        tokens.append((at, end, None if m and m[0] else text[at]))
        at = end
    room = lambda ts: sum(0 if c is None else 1 if ord(c) < 128 else 2 for _, _, c in ts)
    lead = next((s for s, _, c in tokens if c and not c.isspace()), len(text))
    m = re.compile(label).match(text[lead:]) if label else None
    inner = m[0][1:-1] if m else ""
    shows = m and (m[0][0].isalnum() or m[0][-1].isalnum() or m[0][0] not in inner and m[0][-1] not in inner and inner.strip())
    stop = lead + m.end() if shows else 0
    lines, start = [], 0
    while start < len(tokens):
        left = n - len(lines)
        if left == 1 or not any(room(tokens[start : k + 1]) > width and tokens[k][0] >= stop for k in range(start, len(tokens))):
            lines.append(text[tokens[start][0] :])
            break
        end = start
        while room(tokens[start : end + 1]) <= width or tokens[end][0] < stop:
            end += 1
        def after(k):
            return next((c in CLOSING for _, _, c in tokens[k + 1 :] if c and not c.isspace()), False)
        def allowed(k):
            return tokens[k][2] is not None and tokens[k][1] >= stop and not after(k)
        def safe(k):
            c, nxt = tokens[k][2], text[tokens[k][1] : tokens[k][1] + 1]
            return allowed(k) and not (c.isascii() and c.isalnum() and nxt.isascii() and nxt.isalnum()) and c not in OPENING
        places = range(end - 1, start - 1, -1)
        total = room(tokens[start:])
        fits = lambda k: total - room(tokens[start : k + 1]) <= (left - 1) * width or total > left * width
        mark = next((k for k in places if safe(k) and tokens[k][2] in CLOSING), None)
        space = next((k for k in places if safe(k) and tokens[k][2].isspace()), None)
        cut = mark if mark is not None and fits(mark) else space if space is not None and fits(space) else None
        for test in (safe, allowed, lambda k: stop and tokens[k][1] == stop and tokens[k][2] is not None):
            cut = next((k for k in places if test(k)), None) if cut is None else cut
        if cut is None:
            lines += [""] * (n - 1 - len(lines)) + [text[tokens[start][0] :]]
            break
        lines.append(text[tokens[start][0] : tokens[cut][1]])
        start = cut + 1
    return lines + [""] * (n - len(lines))


def test_reflow_by_brute_force():
    rng = random.Random(9)
    parts = ["甲", "乙", "ab", "c", " ", "　", "，", "。", "「", "」", "(", ")", "\\C[1]", "\\!", "【名】", "【", "】", "9", "é", "\n", "!"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        n, width = rng.randint(2, 5), rng.choice([1, 2, 3, 4, 6, 9, 14])
        label, control = rng.choice([("", ""), (LABEL, CONTROL), (LABEL, "")])
        got = fitting._Fitter(Rule(label, control, width)).reflowed(text, n, width)
        assert got == brute_reflow(text, n, width, label, control), (text, n, width, label, control)
        assert "".join(got) == text.replace("\n", "") and len(got) == n


def test_column_equals_plain_python(spark):
    rng = random.Random(10)
    rules = [GAME, Rule(width=20, domain="scroll"), Rule("^「[^」]+」", CONTROL, 0, domain="name", layer=1)]
    words = ["alpha", "beta。", "甲乙丙", "「丁", "」", " ", "\\C[1]", "【名】", "，"]
    line = lambda k: "".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    rows = [(k, rng.choice(["dialogue", "scroll", "name", "other"]), [line(4) for _ in range(rng.randint(0, 3))], [line(rng.choice([3, 20])) for _ in range(rng.randint(0, 4))], rng.randint(0, 4)) for k in range(800)]
    rows += [(900, "dialogue", None, ["a" * 100_000], 3), (901, "dialogue", ["a"], None, 3), (902, None, ["a"], ["b", ""], 2)]
    df = spark.createDataFrame(rows, "id int, domain string, original_lines array<string>, lines array<string>, n int")
    got = {r.id: r for r in fitting.fitted(df, rules, F.col("n")).collect()}
    assert len(got) == len(rows)
    for k, domain, original, lines, n in rows:
        want = (None, 0) if lines is None else fitting.fit_one(domain, original or [], lines, n, fitting.ordered(rules))
        assert (got[k].fit["lines"], got[k].fit.overflow_lines) == want
        assert got[k].fit.reflowed == (lines is not None and want[0] != lines)
    totals = fitting.overflow_counts(fitting.fitted(df, rules, F.col("n"))).collect()
    assert sum(r.units for r in totals) == len(rows) and sum(r.overflow_lines for r in totals) == sum(r.fit.overflow_lines for r in got.values())


def test_a_text_without_controls_is_its_own_tokens():
    """Only texts with controls are taken apart sign by sign; widths and breaks are the same either way."""
    plain, with_control = (fitting._Fitter(fitting.Rule(control=c, width=8)) for c in ("", r"\\[A-Z]"))
    text = "One two, three 字字字 four."
    assert plain.tokens(text)[1] is text and with_control.tokens(text)[1] is text
    assert with_control.tokens("a\\C")[1] == ["a", ""] and with_control.width("a\\C字") == 3
    assert plain.reflowed(text, 4, 8) == with_control.reflowed(text, 4, 8) and "".join(plain.reflowed(text, 4, 8)) == text
