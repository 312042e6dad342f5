import pytest
from pyspark.sql import Row

from silterra.llm import chattemplate as ct


def out(source, **variables):
    return ct.compile_template(source)(**variables)[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{# no #}b", "ab"),
        ("{{ 1 + 2 * 3 }}|{{ (1 + 2) * 3 }}|{{ 7 // 2 }}|{{ 7 % 4 }}|{{ -2 + 1 }}", "7|9|3|3|-1"),
        ("{{ 'a' ~ 1 ~ none ~ true }}", "a1True"),
        ("{{ x.y.z }}|{{ x['y'] | length }}|{{ x.nope.more }}", "5|1|"),
        ("{% if n > 3 and not flag %}big{% elif n == 2 %}two{% else %}small{% endif %}", "two"),
        ("{% for i in items %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q,3r"),
        ("{% for i in [] %}x{% else %}none{% endfor %}", "none"),
        ("a  {%- if true -%}  b  {%- endif -%}  c", "abc"),
        ("{{- ' x ' | trim | upper -}}  !", "X!"),
        ("{% set k = items[1:] %}{{ k | join('+') }}{{ items[-1] }}{{ items[9] }}", "q+rr"),
        ("{{ 'yes' if 'q' in items else 'no' }}{{ 'yes' if 'q' not in items else 'no' }}", "yesno"),
        ("{{ u is defined }}{{ n is not none }}{{ u | default('d') }}", "FalseTrued"),
        ("{{ '\\n{' | length }}{{ [1, 'a'] | tojson }}", '2[1, "a"]'),
        ("{{ items * 1000000 }}{{ 'a' * 5 }}{{ n.__class__ }}{{ items.append }}{{ 1 / 0 }}", ""),
        ("{{ 'x%}' }}", None),
    ],
)
def test_language(source, want):
    variables = {"x": {"y": {"z": 5}}, "n": 2, "flag": False, "items": ["p", "q", "r"]}
    if want is None:
        with pytest.raises(ct.TemplateError):
            ct.compile_template(source.replace("'x%}'", "'x"))
    else:
        assert out(source, **variables) == want


@pytest.mark.parametrize("source", ["{% if x %}", "{% endif %}", "{{ a b }}", "{{ }}", "{{ x.f(y) }}", "{{ (1)(2) }}", "{% macro f %}{% endmacro %}", "{% import os %}", "{{ x | run }}", "{{ x is odd }}", "{{ x", "{% for x of y %}{% endfor %}", "{{ a $ b }}"])
def test_errors(source):
    with pytest.raises(ct.TemplateError):
        ct.compile_template(source)


def test_folding():
    tree = ct.fold(ct.parse("a{{ 1 + 1 }}{% if false %}x{{ y }}{% else %}b{% endif %}{{ 'c' if true else z }}{% if q %}r{% endif %}"))
    assert tree[0] == ct.Text("a2bc") and isinstance(tree[1], ct.If) and len(tree) == 2
    assert ct.fold_expression(ct._Expression("false and x").whole()) == ("const", False)
    assert ct.fold_expression(ct._Expression("true and x").whole()) == ("name", "x")


def test_folding_changes_no_result():
    for source in (ct.CHATML, "{% if 1 == 1 %}{{ m[0].text }}{% endif %}{% generation %}{{ 'k' ~ 2 }}{% endgeneration %}"):
        m = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "ho"}]
        plain = ct._Out()
        ct._block(ct.parse(source))({"messages": m, "m": m}, plain)
        assert ct.compile_template(source)(messages=m, m=m) == ("".join(plain.parts), plain.spans)


def test_spans_are_what_was_generated():
    text, spans = ct.compile_template(ct.CHATML)(messages=[{"role": r, "text": t} for r, t in (("user", "é?"), ("assistant", "one"), ("user", ""), ("assistant", ""))])
    assert [text[a:z] for a, z in spans] == ["one<|im_end|>", "<|im_end|>"]
    assert text.startswith("<|im_start|>user\né?<|im_end|>\n<|im_start|>assistant\none<|im_end|>\n")


def test_awkward_rows(spark):
    long = "word " * 60_000
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (2, 1, "assistant", ""), (None, 1, "user", "x"), (3, 0, "user", long), (3, 1, "assistant", "{{ 1 }}")]
    turns = spark.createDataFrame([Row(conv_id=c, turn=t, role=r, text=x, rendered="mine", messages=1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, rendered string, messages int")
    got = {r.conv_id: r for r in ct.format_conversations(turns).collect()}
    assert got[1].rendered == "<|im_start|>user\na<|im_end|>\n" * 2 + "<|im_start|>assistant\nb<|im_end|>\n" and got[1].n_turns == 3
    assert got[2].rendered == "<|im_start|>\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert got[None].n_turns == 1 and len(got) == 4
    s = got[3].generated[0]
    assert got[3].rendered[s.start : s.end] == "{{ 1 }}<|im_end|>" and long in got[3].rendered
    assert ct.format_conversations(turns.limit(0)).count() == 0


TURNS = [("system", "Be kind."), ("user", " Hi "), ("assistant", "Ho"), ("user", "Bye")]
PUBLISHED = {
    "default system": (
        "{% for message in messages %}{% if loop.first and messages[0]['role'] != 'system' %}{{ '<|im_start|>system\nYou help.<|im_end|>\n' }}{% endif %}{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}",
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user\n Hi <|im_end|>\n<|im_start|>assistant\nHo<|im_end|>\n<|im_start|>user\nBye<|im_end|>\n<|im_start|>assistant\n",
    ),
    "instructions": (
        "{% if messages[0]['role'] == 'system' %}{% set loop_messages = messages[1:] %}{% set system_message = messages[0]['content'] %}{% else %}{% set loop_messages = messages %}{% set system_message = false %}{% endif %}"
        "{% for message in loop_messages %}{% if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('roles must alternate') }}{% endif %}"
        "{% if loop.index0 == 0 and system_message != false %}{% set content = '<<SYS>>\n' + system_message + '\n<</SYS>>\n\n' + message['content'] %}{% else %}{% set content = message['content'] %}{% endif %}"
        "{% if message['role'] == 'user' %}{{ bos_token + '[INST] ' + content.strip() + ' [/INST]' }}{% elif message['role'] == 'assistant' %}{{ ' ' + content.strip() + ' ' + eos_token }}{% endif %}{% endfor %}",
        "<s>[INST] <<SYS>>\nBe kind.\n<</SYS>>\n\n Hi [/INST] Ho </s><s>[INST] Bye [/INST]",
    ),
    "headers": (
        "{% set loop_messages = messages %}{% for message in loop_messages %}{% set content = '<|start_header_id|>' + message['role'] + '<|end_header_id|>\n\n'+ message['content'] | trim + '<|eot_id|>' %}{% if loop.index0 == 0 %}{% set content = bos_token + content %}{% endif %}{{ content }}{% endfor %}",
        "<s>" + "".join(f"<|start_header_id|>{r}<|end_header_id|>\n\n{t.strip()}<|eot_id|>" for r, t in TURNS),
    ),
    "namespace": (
        "{%- set ns = namespace(system='', n=0) -%}\n{%- for m in messages -%}\n  {%- if m.role == 'system' -%}{%- set ns.system = m.content -%}{%- endif -%}\n  {%- set ns.n = ns.n + 1 -%}\n{%- endfor -%}\n{{ ns.system }}|{{ ns.n }}|{{ messages | selectattr('role', 'equalto', 'user') | list | length }}|{{ messages[-1].content.startswith('B') }}",
        "Be kind.|4|2|True",
    ),
    "macro and lines": (
        "{% macro turn(role, text, end='#') %}\n[{{ role }}]{{ text }}{{ end }}\n{% endmacro %}\n{% for m in messages %}\n    {% if m.role in ['user', 'system'] %}\n{{ turn(m.role, m.content) }}\n    {% else %}\n    {% generation %}\n{{ m.content }}\n    {% endgeneration %}\n    {% endif %}\n{% endfor %}\n",
        "[system]Be kind.#\n\n[user] Hi #\n\nHo\n[user]Bye#\n\n",
    ),
}


@pytest.mark.parametrize("name", PUBLISHED)
def test_templates_of_published_forms(spark, name):
    source, want = PUBLISHED[name]
    turns = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(TURNS)] + [(2, 0, "assistant", "x"), (2, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in ct.format_conversations(turns, source, name == "macro and lines", bos_token="<s>", eos_token="</s>", add_generation_prompt=True).collect()}
    assert got[1].rendered == want
    if name == "macro and lines":
        assert [got[1].rendered[s.start : s.end] for s in got[1].generated] == ["Ho\n"]
    assert (got[2].rendered is None) == (name == "instructions") and got[2].n_turns == 2


def test_the_sandbox_of_calls(monkeypatch):
    monkeypatch.setattr(ct, "LONGEST", 1000)
    for source in ("{% set n = namespace(s='xx') %}{% for a in m %}{% set n.s = n.s ~ n.s %}{% endfor %}", "{% macro f() %}{{ f() }}{% endmacro %}{{ f() }}", "{{ nothing() }}", "{% set x.y = 1 %}", "{{ namespace(1) }}", "{% for a, b in m %}{% endfor %}"):
        with pytest.raises(ct.RenderError):
            ct.compile_template(source)(m=list(range(20)))
    assert out("{% for k, v in m.items() %}{{ k }}={{ v }};{% endfor %}{{ m.get('z', 3) }}{{ 'a b'.split() | join('-') }}{{ m.upper() }}", m={"a": 1, "b": 2}) == "a=1;b=2;3a-b"
