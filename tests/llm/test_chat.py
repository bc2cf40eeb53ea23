import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tableproof.llm.chat_format import CONTROLS, TEMPLATE, escape, format_conversations, read_back, unescape
from tableproof.llm.chat_template import Const, TemplateError, Write, compile_template, fold, parse

pieces = st.lists(st.sampled_from([*CONTROLS, "<", "|", "\\", "a", "\n", "[", "/", "é", "<|", "|>"]), max_size=12).map("".join)


@given(pieces)
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    safe = escape(text)
    assert unescape(safe) == text and not any(c in safe for c in CONTROLS)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), pieces), pieces), max_size=6))
@settings(max_examples=200, deadline=None)
def test_rendering_reads_back(turns):
    render = compile_template(TEMPLATE, {"escape": escape})
    got = list(read_back(render({"messages": iter([{"role": r, "text": t} for r, t in turns])})))
    assert [(r, t) for r, t, _, _ in got] == turns
    assert [loss for *_, loss, _ in got] == [t if r == "assistant" else "" for r, t in turns]


def text_of(source, **values):
    return "".join(t for t, _ in compile_template(source, {"up": str.upper})(values))


def test_language():
    assert text_of("{% for x in xs %}{{ loop.index }}{{ x.a | up }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "1P, 2Q"
    assert text_of("{% if a == 1 and b %}x{% elif a == 2 or c %}y{% else %}z{% endif %}", a=2) == "y"
    assert text_of("{% set n = 'a' + \"b\" %}{{ n ~ 1 }}{# no #}") == "ab1"
    assert text_of("{{ 'a' in x }}{{ missing }}", x=["a"]) == "True"
    assert text_of("{{ m['k'] }}", m={"k": 3}) == "3"
    assert list(compile_template("a{% generation %}b{% endgeneration %}c", {})({})) == [("a", False), ("b", True), ("c", False)]


def test_constants_fold():
    assert fold(parse("{% if 1 == 1 %}a{{ 'b' ~ 'c' | up }}{% else %}x{% endif %}d"), {"up": str.upper}) == (Write(Const("abCd")),)


@pytest.mark.parametrize("source", [
    "{% for x in xs %}", "{{ x() }}", "{{ 1 + }}", "{% endif %}", "{% include 'f' %}", "{{ x | nothing }}", "{{ ; }}", "{% if 1 %}{% endfor %}",
])
def test_malformed(source):
    with pytest.raises(TemplateError):
        compile_template(source, {"up": str.upper})


def test_sandbox():
    with pytest.raises(TemplateError):
        text_of("{{ x.__class__ }}", x="text")
    assert text_of("{{ x.__class__ }}", x={}) == ""


def test_query_rows(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, None, None, None), (2, 0, "assistant", "é"), (2, 0, "assistant", "é"),
            (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, packed string")
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    assert set(got) == {1, 2, None}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb</s>\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, 5, hashlib.sha256(b"b</s>").hexdigest())
    assert (got[2].n_turns, got[2].loss_chars) == (3, 2)
    assert got[2].turns_sha256 == hashlib.sha256("\n\nassistant\né\nassistant\né\n".encode()).hexdigest()
    assert got[1].formatted_chars == len("<|turn|>user<|text|>a<|end|><|turn|>assistant<|text|>b<\\/s><|end|>")
    assert format_conversations(df.limit(0)).count() == 0
