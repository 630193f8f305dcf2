import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from runledger.llm import chat_format as cf
from runledger.llm import chat_template as ct


def render(source, **scope):
    return "".join(t for _, t in ct.compile_template(source)(scope))


def test_language():
    assert render("a{{ 1 + 2 * 3 }}b{# no #}") == "a7b"
    assert render("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=iter("abc")) == "1a, 2b, 3c"
    assert render("{% if a is defined and a > 2 %}x{% elif b %}y{% else %}z{% endif %}", b=1) == "y"
    assert render("{{ 'q' ~ x.y['z'] | upper | trim }}{{ nothing }}{{ none }}", x={"y": {"z": " k "}}) == "qK"
    assert render("{%- set n = 3 -%}  {{- n % 2 }} {{ -n }} {{ n // 2 }} {{ 'a' in 'bac' }} {{ 'a' not in 'b' }}") == "1 -3 1 true true"
    assert render("{{ x | default('d') }}{{ (1 == 1) }}{{ 'it\\'s' }}") == "dtrueit's"
    assert list(ct.compile_template("a{% generation %}b{% endgeneration %}")({})) == [(0, "a"), (1, ""), (0, "b"), (2, "")]


def test_folding():
    folded = ct.fold(ct.parse("a{{ 'b' ~ 1 }}{% if 1 > 2 %}x{% else %}c{% endif %}{{ 'd' | upper }}{{ y }}"), ct.FILTERS)
    assert folded == ("block", ("text", "ab1cD"), ("print", ("name", "y")))
    assert ct.fold(ct.parse("{{ false and x }}{{ true and x }}"), ct.FILTERS) == ("block", ("text", "false"), ("print", ("name", "x")))


@pytest.mark.parametrize("bad", ["{{ x.__class__() }}", "{{ f(1) }}", "{% import os %}", "{{ x | eval }}", "{% for x in y %}", "{{ 1 + }}", "{{ a b }}", "{% if x %}", "{{ @ }}", "{% for 1 in x %}{% endfor %}"])
def test_rejected(bad):
    with pytest.raises(ct.TemplateError):
        ct.compile_template(bad)


def test_sandbox():
    class Secret:
        key = "value"

    assert render("{{ x.key }}{{ x.__class__ }}{{ ''.__class__ }}", x=Secret()) == ""
    for bad in ("{{ 'a' * 10 }}", "{{ '%s' % 1 }}", "{{ 1 < 'a' }}", "{{ 1 // 0 }}"):
        with pytest.raises(ct.TemplateError):
            render(bad)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[TURN]", "a\\l"]), st.text(st.sampled_from("a<[\\/INST]s>bl é\n"), max_size=30)), max_size=8), st.integers(1, 60))
def test_reversible(messages, part_chars):
    parts = list(cf.parts_of(({"role": r, "text": t} for r, t in messages), cf.TEMPLATE, part_chars))
    assert [x for p, _ in parts for x in cf.turns(p)] == messages
    assert "".join(cf.unescape(p[a:b]) for p, spans in parts for a, b in spans) == "".join(t for r, t in messages if r == "assistant")
    whole = list(cf.parts_of(({"role": r, "text": t} for r, t in messages), cf.TEMPLATE, 10**9))
    assert len(whole) == 1 and whole[0][0] == "".join(p for p, _ in parts)


def test_long_conversations_fall_into_parts():
    parts = list(cf.parts_of(({"role": "user", "text": "x" * 50} for _ in range(100)), cf.TEMPLATE, 200))
    assert len(parts) > 10 and max(len(p) for p, _ in parts) < 400


def expected(rows):
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    done = []
    for c, ts in out.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        marks = {"user": 13, "assistant": 7}
        chars = sum(len(cf.escape(t)) + (marks[r] if r in marks else 19 + len(cf.escape(r))) for r, t in ts)
        done.append((c, len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss), chars))
    return sorted(done, key=str)


def test_edges(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, None, "user", "y"), (None, 0, "user", "n"), (None, 1, "assistant", "[/INST]"), (2, 0, "user", ""), (2, 0, "user", ""), (2, 0, "assistant", "b"), (3, 5, "tool", "<s>" * 60000), *[(4, i, "user" if i % 2 else "assistant", f"t{i} " * 50) for i in range(3000)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", cf.F.lit("clash"))
    got = sorted((tuple(r) for r in cf.read_back(cf.format_conversations(df)).collect()), key=str)
    assert got == expected(rows)
    assert cf.read_back(cf.format_conversations(df.limit(0))).count() == 0
