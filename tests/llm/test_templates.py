import random

import pytest
from duelframe.llm import templates as T
from hypothesis import given, settings
from hypothesis import strategies as st

FILTERS = {"upper": str.upper, "trim": str.strip, "first": lambda t: t[:1]}


def rendered(source, messages=(), **names):
    out, parts = T.Output(), []
    for _ in T.Template(source, FILTERS).render(iter(messages), out, names):
        parts.append(out.take())
    return "".join(t for t, _ in parts), [t[a:b] for t, spans in parts for a, b in spans]


def walked(body, messages, env):
    """A plain interpreter of the unfolded tree: text and marked texts."""

    def value(e):
        kind = e[0]
        if kind in ("const", "name"):
            return e[1] if kind == "const" else env[e[1]]
        if kind == "field":
            return value(e[1])[e[2]]
        if kind == "filter":
            return FILTERS[e[1]](T._text(value(e[2])))
        if kind == "not":
            return not value(e[1])
        a = value(e[1])
        if kind in ("and", "or"):
            return value(e[2]) if bool(a) == (kind == "and") else a
        return T.OPERATORS[kind](a, value(e[2]))

    text, marked = "", []
    for node in body:
        inner = ("", [])
        if node[0] == "text":
            inner = (node[1], [])
        elif node[0] == "show":
            inner = (T._text(value(node[1])), [])
        elif node[0] == "set":
            env[node[1]] = value(node[2])
        elif node[0] == "generation":
            own, more = walked(node[1], messages, env)
            inner = (own, [*more, own])
        elif node[0] == "if":
            inner = walked(next((b for e, b in node[1] if value(e)), node[2]), messages, env)
        else:
            for i, m in enumerate(messages):
                env[node[1]] = m
                env["loop"] = {"first": i == 0, "last": i == len(messages) - 1, "index": i + 1, "index0": i}
                own, more = walked(node[2], messages, env)
                inner = (inner[0] + own, inner[1] + more)
        text, marked = text + inner[0], marked + inner[1]
    return text, marked


def written(r, depth, inside):
    """A random template."""

    def e(d):
        kind = r.randrange(9) if d else r.randrange(3)
        if kind < 3:
            return r.choice(["'a'", '"b\\n"', "3", "true", "none", "x", *(["m.role", "m['text']", "loop.last", "loop.index0"] if inside else [])])
        if kind == 3:
            return f"(not {e(d - 1)})"
        if kind == 4:
            return f"({e(d - 1)})" + r.choice(["", " | upper", "|trim|first"])
        return f"({e(d - 1)} {r.choice(['~', '==', '!=', 'in', 'and', 'or'])} {e(d - 1)})"

    out = ""
    for _ in range(r.randint(1, 4)):
        kind = r.randrange(6) if depth else r.randrange(2)
        if kind == 0:
            out += r.choice([" t ", "\n", "q{ %}", "{# no #}", " {#- no -#} "])
        elif kind == 1:
            out += "{{" + r.choice(["", "-"]) + e(2) + r.choice(["", "-"]) + "}}"
        elif kind == 2:
            out += "{% set x = " + e(2) + " %}"
        elif kind == 3:
            out += "{% if " + e(2) + " %}" + written(r, depth - 1, inside) + r.choice(["", "{% elif " + e(1) + " -%} z ", "{%- else %}" + written(r, depth - 1, inside)]) + "{% endif %}"
        elif kind == 4 and inside is None:
            out += " "
        else:
            out += written(r, depth - 1, inside)
    return out


def test_compiled_folded_closures_equal_a_plain_interpreter():
    r = random.Random(5)
    for i in range(300):
        source = written(r, 2, False) + "{% for m in messages %}" + written(r, 2, True) + "{% generation %}" + written(r, 1, True) + "{% endgeneration %}{% endfor %}" + written(r, 1, False)
        messages = [{"role": r.choice(["user", "assistant", None]), "text": r.choice(["", "hi", "A b"])} for _ in range(i % 4)]
        assert rendered(source, messages, x="X") == walked(T.parse(source), messages, {"x": "X"}), source


def test_constants_are_folded_away():
    body = T.fold(T.parse("a{{ 'b' ~ 1 ~ none }}{% if 'q' in 'qu' and not false %}c{{ 'd' | upper }}{% else %}{{ m.no }}{% endif %}{% if 1 == 2 %}z{% endif %}"), FILTERS)
    assert body == [("text", "ab1cD")]
    assert T.fold(T.parse("{{ x ~ 'a' ~ 'b' }}"), FILTERS) == [("show", ("~", ("name", "x"), ("const", "ab")))]
    assert T.fold(T.parse("{% if false %}1{% elif x %}2{% elif true %}3{% else %}4{% endif %}"), FILTERS) == [("if", [(("name", "x"), [("text", "2")])], [("text", "3")])]


@pytest.mark.parametrize("source", [
    "{{ }}", "{{ 'a }}", "{% if x %}", "{% endfor %}", "{% while true %}{% endwhile %}", "{{ f(1) }}", "{{ x | nothing }}", "{% for m in x %}{% endfor %}",
    "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}",
    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% if x %}{% for m in messages %}{% endfor %}{% endif %}", "{% set true = 1 %}", "{{ x.1 }}", "{{ x ; y }}", "{{ a b }}",
])
def test_what_the_language_lacks_does_not_compile(source):
    with pytest.raises(T.TemplateError):
        T.Template(source, FILTERS)


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ x['__init__'] }}", "{{ open }}", "{{ messages }}", "{{ __builtins__ }}"])
def test_python_is_out_of_reach(source):
    with pytest.raises(T.TemplateError):
        rendered(source, x="text")


def test_a_stream_is_read_one_turn_ahead():
    taken = []

    def turns():
        for i in range(5):
            taken.append(i)
            yield {"role": "user", "text": str(i)}

    out = T.Output()
    steps = T.Template("{% for m in messages %}{{ m.text }}{% if not loop.last %},{% endif %}{% endfor %}.").render(turns(), out)
    next(steps)
    assert taken == [0, 1] and out.take() == ("0,", [])
    assert [None for _ in steps] and out.take()[0] == "1,2,3,4."


CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
escape, unescape = T.escaper(CONTROLS)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<", "s>", "/s>", "[", "/", "INST]", "\\", "\\\\", "<s>", "[/INST]", "a", "é"])).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    safe = escape(text)
    assert unescape(safe) == text and not any(c in safe for c in CONTROLS)
    assert text != safe or not any(c in text for c in CONTROLS)


def test_controls_that_could_overlap_are_refused():
    for controls in (("<s>", "<<s>>"), ("\\s",), ("ab", "ba")):
        with pytest.raises(ValueError):
            T.escaper(controls)
