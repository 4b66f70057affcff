"""All facts of each kind against plain ``ast``."""

import ast

import pytest

from rulegrain.plans import derive, expected, facts

FILES = {
    "calls.py": """import os, pickle, hashlib
eval(a); exec(b)
os.system('ls')
x = pickle.loads(
    blob,
    encoding='latin1',
)
get().eval(hashlib.md5(x))
conn.executemany('%s' % sql, rows)
cur.execute(f'SELECT {x}')
yaml.load(h, yaml.SafeLoader); yaml.load(h, Loader=yaml.Loader, **more)
server.run(debug=True, shell=False, host='0.0.0.0', mode=SafeMode)
(lambda: 1)()
""",
    "sub/assigns.py": """auth_token = 'k'
mailPassword = DEBUG = True
ALLOWED_HOSTS = ['a', '*']
blank = ' '
a.b = 'not a name'
c, d = 'tuple', 2
""",
    "consts.py": '"""Text\nof a module"""\nx = f"0.0.0.0{y}" + "é"\nz = b"bytes"\n',
}


def dotted(func):
    match func:
        case ast.Attribute():
            inner = dotted(func.value)
            return f"{inner}.{func.attr}" if inner else func.attr
        case ast.Name():
            return func.id
    return ""


def dynamic(arg):
    if isinstance(arg, ast.JoinedStr):
        return any(isinstance(v, ast.FormattedValue) for v in arg.values)
    if isinstance(arg, ast.BinOp):
        return isinstance(arg.op, (ast.Add, ast.Mod))
    return isinstance(arg, ast.Call) and isinstance(arg.func, ast.Attribute) and arg.func.attr == "format"


def plain(kind, files=FILES):
    """The facts of files by ast.walk, without ``seq``."""
    for path, text in files.items():
        for node in ast.walk(ast.parse(text)):
            if not hasattr(node, "lineno"):
                continue
            at = ("r", path, node.lineno, node.col_offset + 1, text.splitlines()[node.lineno - 1].strip())
            safe = lambda e: "Safe" in ast.dump(e)
            if kind == "call" and isinstance(node, ast.Call):
                truth = lambda e: {True: "True", False: "False"}.get(e.value) if isinstance(e, ast.Constant) else None
                keywords = [(k.arg, truth(k.value), safe(k.value)) for k in node.keywords]
                attr = getattr(node.func, "attr", None)
                args = node.args
                yield (*at, dotted(node.func), attr is not None, attr, keywords, len(args), bool(args) and dynamic(args[0]), safe(args[1]) if args[1:] else None)
            elif kind == "assign" and isinstance(node, ast.Assign):
                value = getattr(node.value, "value", None) if isinstance(node.value, ast.Constant) else None
                parts = node.value.elts if isinstance(node.value, (ast.List, ast.Tuple)) else []
                star = any(isinstance(e, ast.Constant) and e.value == "*" for e in parts)
                for name in [t.id for t in node.targets if isinstance(t, ast.Name)]:
                    yield (*at, name, isinstance(value, str) and bool(value.strip()), star, value is True)
            elif kind == "const" and isinstance(node, ast.Constant) and isinstance(node.value, str):
                yield (*at, node.value)


@pytest.mark.parametrize("kind", facts.COLUMNS)
def test_facts_agree_with_plain_ast(corpus_of, kind):
    columns = [c for c in facts.COLUMNS[kind] if c != "seq"]
    rows = facts.facts_of(corpus_of(FILES), kind).select(*columns).collect()
    got = [tuple([tuple(k) for k in v] if isinstance(v, list) else v for v in r) for r in rows]
    want = list(plain(kind))
    assert len(want) > 5 and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("kind", facts.COLUMNS)
def test_expected_facts_are_those_of_the_templates(kind):
    """The tables that SQL compares with hold what plain ``ast`` finds in each template."""
    listed = {"call": expected.CALLS, "assign": expected.ASSIGNS, "const": expected.CONSTS}[kind]
    found = []
    for no, text in enumerate(derive.PY_TEXTS):
        try:
            rows = list(plain(kind, {str(no): text}))
        except SyntaxError:
            continue
        for _, _, line, column, _, name, *more in rows:
            if kind == "call":
                _, attr, keywords, n, builds, safe = more
                shown = " ".join(f"{a}={v or '-'}{'/safe' if s else ''}" for a, v, s in keywords)
                more = [attr, shown, n, builds, safe]
            found.append((no, line, column, name, *more))
    assert sorted(found, key=repr) == sorted(listed, key=repr)


def test_each_content_is_parsed_once(spark, corpus_of):
    """Copies in many places have the facts of the one that is parsed."""
    from rulegrain.operators import pyfacts

    files = FILES | {f"vendor/{i}/{name}": text for i in range(5) for name, text in FILES.items()} | {"broken.py": "while queue\n", "empty.py": ""}
    sources = pyfacts.python_sources(corpus_of(files))
    for watched in (True, False):
        plain_rows, by_content = pyfacts.py_facts(sources, watched), pyfacts.facts_by_content(sources, watched)
        assert by_content.columns == plain_rows.columns
        assert sorted(map(repr, by_content.collect())) == sorted(map(repr, plain_rows.collect()))
