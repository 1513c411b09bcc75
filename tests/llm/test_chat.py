import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlake.llm import chat
from strandlake.llm.template import Generation, Literal, Output, Template, TemplateError


def _render(source, **variables):
    return Template(source, {"up": lambda s: (s or "").upper()}).render(**variables)


def test_language():
    assert _render("a{{ x }}b{# c #}{{ 'q' + 1 }}{{ 1 + 2 }}", x=None) == "abq13"
    assert _render("{% if a and not b or 'z' in c %}1{% elif b %}2{% else %}3{% endif %}", a=True, b=False, c="") == "1"
    assert _render("{% if a == 'k' %}1{% elif b != 2 %}2{% else %}3{% endif %}", a="x", b=2) == "3"
    assert _render("{% for m in ms %}{{ loop.index0 }}{{ m.t | up }}{% if not loop.last %},{% endif %}{% endfor %}", ms=iter([{"t": "a"}, {"t": None}, {"t": "c"}])) == "0A,1,2C"
    assert _render("{{ m['role'] }}{{ m.gone }}{{ m.upper }}", m={"role": "r"}) == "r"
    assert _render("{{ '\\n' }}{{ \"it's\" }}{{ true }}") == "\nit'strue"


def test_constants_are_folded():
    t = Template("{% if 'a' == 'a' %}x{{ 'y' | up }}{% else %}{{ z }}{% endif %}{{ 1 + 1 }}{% generation %}{{ '' }}{% endgeneration %}", {"up": str.upper})
    assert t.tree == (Output(Literal("xY2")), Generation(()))


@pytest.mark.parametrize("source", ["{{ x", "{% if a %}", "{% for a in %}{% endfor %}", "{{ a() }}", "{{ a | nope }}", "{{ }}", "{% import os %}", "{{ a.__class__() }}", "{{ 1 ? }}", "{{ a b }}", "{{ a[1] }}"])
def test_refusals(source):
    with pytest.raises(TemplateError):
        Template(source, {})


def test_sandbox():
    assert Template("{{ a.__class__ }}{{ a.keys }}", {}).render(a={"k": 1}) == ""
    assert Template("{{ a.real }}", {}).render(a=5) == ""


@given(st.text(alphabet="\\#</turn> :\nab é"), st.text(alphabet="\\#</turn> :\nab"))
def test_escapes_are_reversible(text, role):
    formatted = f"### {chat.label(role)}: {chat.escape(text)}</turn>\n"
    assert chat.parse_turn(formatted) == (role, text)
    assert chat.unescape(chat.escape(text)) == text


def test_round_trip(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a\nb", 0), (1, 2, "assistant", None, 0), (1, 3, None, "x", 0), (1, 4, "system: a\n", chat.PROBE_TEXT, 0), (2, 0, "assistant", "é🙂" * 50, 0), (2, 0, "assistant", "é🙂" * 50, 0), (2, None, "user", "", 0), (None, 1, "assistant", "n", 0)]
    rows += [(3, k, ("user", "assistant")[k % 2], f"turn {k} </turn>\n### user: ", 0) for k in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(f"### {chat.label(role)}: {chat.escape(text)}</turn>\n") for _, role, text in turns)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
