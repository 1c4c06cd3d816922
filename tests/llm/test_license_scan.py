"""Licence templates against a recursive matcher, regular expressions and texts by hand."""

import random
import re

import pytest
from llm.conftest import ODD, frame

from veilwright.llm import license_scan
from veilwright.llm.license_scan import PHRASES, TEMPLATES, Region, Scanner, Template, expression, largest_share, parse, scan


def ends(parts, words, i):
    """All ends of runs from ``i`` that the parts accept, tried one by one."""
    if not parts:
        return {i}
    head, rest = parts[0], parts[1:]
    if isinstance(head, bytes):
        return ends(rest, words, i + 1) if i < len(words) and words[i] == head else set()
    if isinstance(head, Region):
        out, test = set(), re.compile(head.match.encode())
        for n in range(head.most + 1):
            if n >= head.least:
                out |= ends(rest, words, i + n)
            if i + n >= len(words) or not test.fullmatch(words[i + n]):
                break
        return out
    return ends(rest, words, i) | ends([*head, *rest], words, i)


def plain_places(template, label, words):
    parts, out, i = parse(template), [], 0
    while i < len(words):
        last = max(ends(parts, words, i), default=i)
        if last > i:
            out.append((label, i, last - 1))
            i = last
        else:
            i += 1
    return out


MADE = {
    "a": 'x <<beginOptional>>y <<beginOptional>>z<<endOptional>><<endOptional>> x',
    "b": '<<beginOptional>>x<<endOptional>> <<var;name="n";original="y";match="y|z";words="0-2">> z w',
    "c": 'w <<var;name="n";original="";words="1-3">> w',
    "d": '<<beginOptional>>x y<<endOptional>><<beginOptional>>x z<<endOptional>> w <<beginOptional>>w<<endOptional>>',
    "e": 'x y',
}


def test_automata_equal_trying_everything():
    rng = random.Random(3)
    scanner = Scanner({}, MADE)
    for _ in range(2000):
        words = [rng.choice([b"w", b"x", b"y", b"z"]) for _ in range(rng.randrange(14))]
        _, own = scanner.places(words)
        for label, template in MADE.items():
            assert [p for p in own if p[0] == label] == plain_places(template, label, words), (label, words)


FILL = {"thing": "work", "verb": "licensed", "version": "3", "kind": "", "holder": "the authors", "id": "MIT"}


def filled(template, optional):
    """The template as a text: regions as their original says, optional words in or out."""
    def value(m):
        fields = dict(license_scan.FIELD.findall(m[0]))
        return fields["original"] or FILL[fields["name"]]

    text = re.sub("<<var;.*?>>", value, template, flags=re.DOTALL)
    while not optional and "<<beginOptional>>" in text:
        text = re.sub("<<beginOptional>>(?:(?!<<).)*<<endOptional>>", "", text, flags=re.DOTALL)
    return text.replace("<<beginOptional>>", " ").replace("<<endOptional>>", " ")


@pytest.mark.parametrize("label", sorted(TEMPLATES))
@pytest.mark.parametrize("optional", [True, False])
def test_every_template_accepts_its_text_and_nothing_less(label, optional):
    words = license_scan.split_words(filled(TEMPLATES[label], optional).upper().encode())
    one = Template(label, TEMPLATES[label])
    assert one.longest(words, 0) == len(words)
    assert one.longest([b"before", *words, b"after"], 1) == len(words) + 1
    for i, w in enumerate(words):  # a mandatory word changed: the whole is accepted no more
        changed = [*words[:i], b"qqq", *words[i + 1:]]
        whole = len(words) in ends(parse(TEMPLATES[label]), changed, 0)
        assert (one.longest(changed, 0) == len(words)) == whole, w


def test_expressions_say_the_same():
    for label, template in TEMPLATES.items():
        e = re.compile(expression(parse(template)))
        for optional in (True, False):
            words = license_scan.split_words(("so " + filled(template, optional) + " there").encode())
            text = "".join(f"<{w.decode()}>" for w in words)
            assert [m[0].count("<") for m in e.finditer(text)] == [
                b - a + 1 for _, a, b in plain_places(template, label, words)], label


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_scan(spark):
    docs = [(1, "Fine print.\nThis work is licensed under the GNU General Public License, version 3."), (2, "the MIT license"),
            (3, "CC BY cc-by CC\tBY"), (4, "Apache License apache LICENSE"), (5, "gnu general public  licence"), (6, None), (7, ""),
            (8, "a" * 100_000), (9, "SPDX-License-Identifier: Apache-2.0"), (None, "mit license")]
    rows = by_id(scan(frame(spark, docs)))
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].last_word) == (14, 1, 8, 8)
    assert (rows[1].base_labels, rows[1].labels, rows[1].score) == ("gpl", "gpl,gpl-notice", 12 / 14)
    assert [tuple(p) for p in rows[1].places] == [("gpl", 8, 11), ("gpl-notice", 2, 13)]
    assert (rows[2].labels, rows[2].score) == ("mit", 2 / 3)
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].score) == (3, 0, 4, 1.0)
    assert (rows[4].n_base, rows[4].base_labels) == (2, "apache")
    for i in (5, 6, 7, 8):
        assert (rows[i].n_base, rows[i].first_word, rows[i].labels, rows[i].score) == (0, None, "", 0.0)
    assert rows[9].labels == "spdx-tag" and rows[9].base_labels == "" and rows[None].base_labels == "mit"


def test_odd_rows(spark, odd, none):
    rows = scan(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert scan(none).count() == 0
    again = frame(spark, [(1, "mit license")] * 3)
    assert [r.n_base for r in scan(again).collect()] == [1, 1, 1]


def test_shares_count_a_word_once():
    assert largest_share(4, [("a", 0, 1), ("a", 1, 2), ("b", 0, 0)]) == 0.75
    assert largest_share(0, []) == 0.0


def test_faulty_templates():
    for text in ("<<beginOptional>>a", "a<<endOptional>>", '<<var;name="x";words="2-1">> a', "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            Template("t", text)
    assert set(PHRASES.values()) == {"gpl", "apache", "cc-by", "mit"}
