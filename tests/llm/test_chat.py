import hashlib
import subprocess
import sys
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from wortnetz.llm import chat
from wortnetz.llm.templates import Const, Put, TemplateError, compile_template, escape, escape_line, fold, parse, unescape

SAYS = [("user", "hi <turn> \\n"), ("assistant", "</turn>\nok\\"), ("assistant", ""), ("system", "a\nb"), ("rôle\nx", "🙂 \\### Assistant: </turn> ok"), (None, None)]


def render(source, messages):
    return "".join(p[0] for p in compile_template(source)(iter(messages)) if p)


@given(st.text(alphabet="<>\\n/tur ab\n"))
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text == unescape(escape_line(text))
    assert "\n" not in escape_line(text) and "<" not in escape(text).replace("\\\\", "").replace("\\<", "")


def test_language():
    m = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yo"}]
    assert render("{% for x in messages %}{{ loop.index }}{% if loop.first %}F{% elif x.role != 'user' and not loop.first %}A{% else %}-{% endif %}{{ x.text | trim | upper }}{% endfor %}", m) == "0FHI1AYO"
    assert render("a{{ 'b' ~ \"c\" | upper }}{% if 'x' == 'y' %}no{% endif %}d", m) == "abCd"
    assert render("{% for x in messages %}{% if loop.last %}{{ x.role }}{% endif %}{% endfor %}", m) == "assistant"
    marked = list(compile_template("{% for x in messages %}{% if x.role == 'assistant' %}{% generation %}{{ x.text }}{% endgeneration %}{% endif %};{% endfor %}")(iter(m)))
    assert marked == [(";", False), None, ("yo", True), (";", False), None]


def test_folding():
    assert fold(parse("a{{ 'b' }}{% if true or false %}c{% else %}{{ 'd' }}{% endif %}{% if not true %}e{% endif %}")) == (Put(Const("abc")),)
    assert len(fold(parse("{% for m in messages %}x{{ 'y' | upper }}{{ m.text }}{% endfor %}"))[0].body) == 2


@pytest.mark.parametrize("bad", ["{{ x }}", "{% for m in messages %}", "{{ messages.pop }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ 'a'.upper() }}", "{{ 'a' | eval }}", "{% import os %}", "{% for m in other %}{% endfor %}", "{{ }}", "{{ 'a' 'b' }}", "{% endif %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}"])
def test_the_sandbox_refuses(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_conversations_read_back(spark):
    rows = [(c, t, *SAYS[(c + t) % len(SAYS)], 9) for c in range(40) for t in range(c % 7 + 1)]
    rows += [(None, 0, "user", "x", 9), (0, 5, "user", "b", 9), (0, 5, "user", "a", 9), (0, 5, "user", "a", 9), (0, None, "assistant", "first", 9), (99, 0, "assistant", "y" * 50_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int").repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.where("conv_id < 0"))).count() == 0


def test_a_template_of_one_s_own(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    rows = chat.format_conversations(df, "<s>{% for m in messages %}[{{ m.role }}] {% generation %}{{ m.text }}{% endgeneration %}\n{% endfor %}</s>").orderBy("seq").collect()
    assert "".join(r["formatted"] for r in rows) == "<s>[user] q\n[assistant] a\n</s>"
    assert [[r["formatted"][s["start"] : s["end"]] for s in r["loss"]] for r in rows] == [["q"], ["a"], []]


LONG = """
import resource
import pandas as pd
from wortnetz.llm import chat
said = "<a \\\\ b>\\n" * (20_000_000 // 9)
rows = pd.DataFrame({"no_id": [False], "id": [1], "role": ["assistant"], "text": [said]})
out = pd.concat(chat._renderer(chat.TEMPLATE, "conv_id")(iter([rows])))
read = pd.concat(chat._read(iter([out.assign(no_id=False, id=1)])))
assert read["n_turns"].tolist() == [1] and read["loss_chars"].tolist() == [len(said)]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""


def test_a_turn_of_20_million_characters_stays_below_a_gigabyte():
    kilobytes = int(subprocess.run([sys.executable, "-c", LONG], check=True, capture_output=True, text=True).stdout)
    assert kilobytes < 1 << 20


def test_a_large_conversation_without_id(spark):
    df = spark.range(60_000).selectExpr("cast(if(id % 3 = 0, null, id) AS bigint) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "cast(id AS string) AS text")
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_conversations(df)).where("conv_id IS NULL OR conv_id < 10").collect()}
    assert got == {None: 20_000, **{k: 1 for k in range(10) if k % 3}}
