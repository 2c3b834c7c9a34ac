"""Templates as columns against a plain renderer of the same tree, on random templates and rows."""

import random

import pytest
from parley.operators import templates

SHAPE = "a string, n long, flag boolean, items array<string>, people array<struct<name:string,age:long>>"
ROWS = [
    ("x & y", 3, True, ["p", None, ""], [("Ann", 3), (None, 0)]),
    ("", 0, False, [], []),
    (None, None, None, None, None),
    ("0", -1, True, ["one"], [("é", None)]),
]


def truth(v):
    return bool(v)


def shown(v):
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def random_test(rnd, loops, depth=0):
    kind = rnd.randrange(6 if depth < 2 else 3)
    if kind == 0:
        name = rnd.choice(["a", "n", "flag", "items", "people", "missing", *loops])
        return name, lambda row: truth(row.get(name))
    if kind == 1:
        return "a == 'x & y'", lambda row: row.get("a") == "x & y"
    if kind == 2:
        return "n != 3", lambda row: row.get("n") != 3
    one, f = random_test(rnd, loops, depth + 1)
    if kind == 3:
        return f"not ({one})", lambda row: not f(row)
    two, g = random_test(rnd, loops, depth + 1)
    if kind == 4:
        return f"({one}) and ({two})", lambda row: f(row) and g(row)
    return f"({one}) or ({two})", lambda row: f(row) or g(row)


def random_template(rnd, loops=(), depth=0):
    """Source and a plain renderer."""
    sources, parts = [], []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.randrange(6 if depth < 3 else 3)
        if kind == 0:
            text = rnd.choice(["word ", "\n", " {x} ", "%", "", "line\n  in"])
            sources.append(text)
            parts.append(lambda row, text=text: text)
        elif kind < 3:
            name, how, f = rnd.choice([("a", "", shown), ("n", "", shown), ("flag", "", shown), ("a", " | upper", lambda v: shown(v).upper()), ("a", " | default('none')", lambda v: "none" if v is None else v), ("items", " | length", lambda v: "" if v is None else len(v)), ("items", " | join(', ')", lambda v: "" if v is None else ", ".join(x or "" for x in v)), ("a", " | trim | lower", lambda v: shown(v).strip(" ").lower()), *[(x, "", shown) for x in loops]])
            sources.append("{{ " + name + how + " }}")
            parts.append(lambda row, name=name, f=f: shown(f(row.get(name))))
        elif kind == 3:
            ways = [(random_test(rnd, loops), random_template(rnd, loops, depth + 1)) for _ in range(rnd.randint(1, 3))]
            other = random_template(rnd, loops, depth + 1) if rnd.random() < 0.5 else None
            source = "".join(("{% if " if i == 0 else "{% elif ") + t[0] + " %}" + body[0] for i, (t, body) in enumerate(ways))
            sources.append(source + ("{% else %}" + other[0] if other else "") + "{% endif %}")

            def choose(row, ways=ways, other=other):
                return next((body[1](row) for t, body in ways if t[1](row)), other[1](row) if other else "")

            parts.append(choose)
        else:
            name = f"v{depth}"
            source, f = random_template(rnd, (*loops, name), depth + 1)
            sources.append("{% for " + name + " in items %}{{ loop.index }}" + source + "{% if not loop.last %},{% endif %}{% endfor %}")

            def loop(row, name=name, f=f):
                items = row.get("items") or []
                return "".join(f"{i + 1}{f({**row, name: x})}{',' if i + 1 < len(items) else ''}" for i, x in enumerate(items))

            parts.append(loop)
    return "".join(sources), lambda row: "".join(p(row) for p in parts)


def test_random_templates_render_as_by_hand(spark):
    rnd, df = random.Random(12), spark.createDataFrame(ROWS, SHAPE)
    made = [random_template(rnd) for _ in range(60)]
    got = df.select(*[templates.compiled(source + "\n", df).alias(f"c{i}") for i, (source, _) in enumerate(made)]).collect()
    rows = [dict(zip(("a", "n", "flag", "items", "people"), r)) for r in ROWS]
    for i, (source, render) in enumerate(made):
        assert [r[i] for r in got] == [render(r) for r in rows], source


def test_fields_of_structs_dashes_and_comments(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SHAPE)
    text = "{# who #}{% for p in people -%}\n  {{ p.name | default('?') }}={{ p.age }}\n{%- if not loop.last %}; {% endif %}{% endfor %}\n"
    (tmp_path / "t.txt").write_text(text)
    column = templates.compiled(templates.load_template(spark, str(tmp_path / "t.txt")), df)
    assert [r[0] for r in df.select(column).collect()] == ["Ann=3; ?=0", "", "", "é="]
    plan = df.select(column)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("bad", ["{% if a %}x", "{{ a | shout }}", "{% while a %}", "{{ a + }}", "{% for x in a %}{% endfor %}", "{{ }}"])
def test_faulty_templates_are_refused(spark, bad):
    with pytest.raises(ValueError):
        templates.compiled(bad, spark.createDataFrame(ROWS, SHAPE))
