import hashlib

import pytest
from fixtures_llm import bag
from hypothesis import given, settings
from hypothesis import strategies as st

from skygrade.llm import chat
from skygrade.llm.template import Emit, TemplateError, Text, compile_template, fold_all, parse

UPPER = {"upper": str.upper}


def render(source, **values):
    return compile_template(source, UPPER)(**values)


def test_language():
    assert render("{{ a.b }}{{ a['c'] | upper }}{{ x[1] }}", a={"b": 1, "c": "q"}, x=["u", "v"])[0] == "1Qv"
    assert render("{% for m in ms %}{% if m == 1 %}one{% elif not m %}none{% else %}{{ m + 1 }}{% endif %},{% endfor %}", ms=[1, 0, 4])[0] == "one,none,5,"
    assert render("{% set y = 'a' + \"\\n\" %}{{ y }}{{ missing }}{% if 'b' in 'abc' and (false or true) %}!{% endif %}")[0] == "a\n!"
    text, spans = render("é{% for m in ms %}<{% generation %}{{ m }}{% endgeneration %}>{% endfor %}", ms=["ab", "", "c"])
    assert text == "é<ab><><c>" and [text[a:b] for a, b in spans] == ["ab", "", "c"]


def test_constants_are_folded():
    folded = fold_all(parse("a{{ 'b' | upper }}{% if 1 == 2 %}x{% elif true %}c{% else %}y{% endif %}{{ 'd' + 'e' }}{{ z }}"), UPPER)
    assert folded[0] == Text("aBcde") and isinstance(folded[1], Emit) and len(folded) == 2


@pytest.mark.parametrize("source", ["{{ ''.__class__ }}", "{{ x.__class__ }}", "{{ f() }}", "{{ x | evil }}", "{% for %}", "{% if x %}", "{% import os %}", "{{ a b }}", "{{ m }}"])
def test_nothing_but_given_values_can_be_reached(source):
    with pytest.raises(TemplateError):
        render(source, x="text", f=print, m={"a": 1})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>"]), st.text(st.sampled_from("\\<[]/sINST>aé\n") | st.characters(exclude_categories=["Cs"]), max_size=30)), max_size=5))
def test_texts_read_back(turns):
    made = compile_template(chat.TEMPLATE, {"escape": chat.escape})
    text, spans = made(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        chat.read_back("<s>[INST]user[/INST]a</s>x")


def test_tables(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", said), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "assistant", None), (3, None, "assistant", "x" * 300_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(table)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 2, sha("bb"))
    assert got[1].turns_sha256 == sha(f"user\n{said}\nassistant\nb\nassistant\nb\n")
    assert (got[2].n_turns, got[2].loss_chars, got[2].turns_sha256) == (1, 0, sha("\n\n"))
    assert (got[None].n_turns, got[None].loss_chars) == (1, 0) and got[3].loss_chars == 300_000
    assert chat.chat_digests(chat.format_chats(table.limit(0))).collect() == []
    assert bag(chat.format_chats(table.where("conv_id = 2")), "text") == [("<s>[INST][/INST]</s>",)]
    with pytest.raises(TemplateError):
        chat.format_chats(table, "{% for %}")
