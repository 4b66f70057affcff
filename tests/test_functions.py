"""Scalar expressions against plain Python."""

import fnmatch
import itertools
import math

from pyspark.sql import functions as F

from rulegrain.functions import paths, text as t, versions as v, web
from rulegrain.operators import remediate as fix


def column(spark, values, expr, schema="v string"):
    rows = [(x,) if not isinstance(x, tuple) else x for x in values]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_lines_of(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\n\n", "x\x0by\x0cz\x1c\x1d\x1e\x85\u2028\u2029", "\n"]
    assert column(spark, texts, t.lines_of(F.col("v"))) == [x.splitlines() for x in texts]


def test_strip_and_decoding(spark):
    texts = ["\u3000 a b\x1f\n", "   ", "x", "\xa0\u2003y\x85"]
    assert column(spark, texts, t.py_strip(F.col("v"))) == [x.strip() for x in texts]
    raw = [b"ab\xff\xc3(c\xef\xbf\xbd\xed\xa0\x80d", b"plain", b"\xe2\x82"]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "c binary")
    assert [r[0] for r in df.select(t.lenient_text(F.col("c"))).collect()] == [b.decode("utf-8", "ignore") for b in raw]
    assert [r[0] for r in df.select(t.strict_text(F.col("c"))).collect()] == [None, "plain", None]


def test_entropy(spark):
    texts = ["hT6wq0Vz9LxB", "aaaa", "\U0001f600ab", ""]
    want = [-sum(x.count(c) / len(x) * math.log2(x.count(c) / len(x)) for c in set(x)) if x else 0.0 for x in texts]
    got = column(spark, texts, t.shannon_entropy(F.col("v")))
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_versions(spark):
    pairs = [("1.2.3", "1.2.4", -1), ("2.0.0", "1.9.9", 1), ("1.0", "1.0.0", 0), ("5.4rc1", "5.4", 0), ("1.10", "1.9", 1), ("x", "0", 0)]
    pairs.append(("1.20230101123456789012345", "1.20230101123456789012344", 1))
    got = column(spark, [(a, b) for a, b, _ in pairs], v.compare_version(F.col("a"), F.col("b")), "a string, b string")
    assert got == [c for *_, c in pairs]
    specs = [("5.3", "<5.4", True), ("5.4", "<5.4", False), ("1", " >= 1.0 ", True), ("3", ">2,<3", True), ("1", "~=1", False), ("1", "==1.0", True)]
    got = column(spark, [(a, b) for a, b, _ in specs], v.is_vulnerable(F.col("a"), F.col("b")), "a string, b string")
    assert got == [c for *_, c in specs]
    raws = {"^1.2.3": "1.2.3", "~=2": "2", "*": None, ">=2,<3": None, "1.2.x": "1.2", "latest": None, " =1.0-rc": "1.0"}
    assert column(spark, list(raws), v.clean_version(F.col("v"))) == list(raws.values())


def test_requirement_shapes(spark):
    lines = ["PyYAML==5.3.1", "  a == 1.0  # x", "a[x]==1", "a===1", "a>=1", "a==x1"]
    assert column(spark, lines, v.bump_requirement(F.col("v"), F.lit("9"))) == ["PyYAML==9", "  a==9  # x", None, None, None, None]
    assert column(spark, ["a==9"], v.bump_requirement(F.col("v"), F.lit("9"))) == [None]


PATHS = [
    ".env", "svc/.env", "a/b/.env.local", "build/.env", "legacy/old.py", "src/legacy/x.py", "legacy", "x.min.js", "a/x.min.js",
    "src/app.js", "[x].js", "a-b/c]d", "caf\u00e9/\U0001f600.js", "dir.d/f",
]
PATTERNS = [
    "*.min.js", "legacy/", "legacy", "src/*", "*", "?env", ".e*", "*.e[nm]v", "[!a-c]*", "[z-a]*", "[!z-a]*", "[x].js", "[[]x].js", "a/b",
    "x[", "*/.env", "**/f", "/", "dir.d", "[]]", "a[-]b/*", "*\U0001f600*", "*.js", "s?c/app.js", "[a\\]*", "/svc/", "build//",
]


def suppressed(path, pat):
    if pat.endswith("/"):
        stem = pat.rstrip("/")
        return path == stem or path.startswith(stem + "/") or f"/{stem}/" in "/" + path
    base = path.rsplit("/", 1)[-1]
    return any(fnmatch.fnmatchcase(s, g) for s, g in ((path, pat), (base, pat), (path, "*/" + pat)))


def ignored(path, line):
    pat, base = line.lstrip("/"), path.rsplit("/", 1)[-1]
    tests = ((base, pat), (path, pat), (path, "*/" + pat), (path, pat.rstrip("*") + "*"))
    return any(fnmatch.fnmatchcase(s, g) for s, g in tests)


def test_globs_against_fnmatch(spark):
    pairs = list(itertools.product(PATHS, PATTERNS))
    df = spark.createDataFrame(pairs, "path string, pat string")
    rows = df.select("path", "pat", paths.path_glob(F.col("path"), F.col("pat")), paths.gitignore_match(F.col("path"), F.col("pat"))).collect()
    assert [(p, g) for p, g, hit, _ in rows if hit != suppressed(p, g)] == []
    assert [(p, g) for p, g, _, hit in rows if hit != ignored(p, g)] == []


def test_dispatch(spark):
    names = {
        "a.py": ["python", "secret"], "a.pyw": ["python"], "a.mjs": ["js"], "b/A.TSX": ["js", "secret"], "f.go": ["go", "secret"],
        "F.java": ["java", "secret"], "requirements.txt": ["dependency", "secret"], "x/Package.JSON": ["dependency", "secret"],
        ".env": [], "a.env": ["secret"], ".env.local": [], "README.md": [], "..py": [], "x.py/": [], "a.b.yml": ["secret"],
    }
    assert column(spark, list(names), paths.scanners_for(F.col("v"))) == list(names.values())
    got = column(spark, ["build/a", "a/build", "a/.git/b", "builds/a"], paths.in_pruned_dir(F.col("v")))
    assert got == [True, False, True, False]


def test_env_names(spark):
    files = {".env": True, ".env.local": True, ".env.example": False, ".envrc": True, "x.env": False, ".env.prod.dist": False}
    assert column(spark, list(files), paths.is_secret_env_name(F.col("v"))) == list(files.values())
    names = {"apiKey": "API_KEY", "db-password": "DB_PASSWORD", "__x": "X", "HTTPToken2Key": "HTTPTOKEN2_KEY"}
    assert column(spark, list(names), t.env_name(F.col("v"))) == list(names.values())


def test_web(spark):
    urls = {"https://x/": "https", "HTTP://x": "http", "/rel": "", " https://x": "https", "1x:y": "", "a b:c": ""}
    assert column(spark, list(urls), web.url_scheme(F.col("v"))) == list(urls.values())
    assert column(spark, [" sid = a=b; Secure"], web.cookie_name(F.col("v"))) == ["sid"]
    assert column(spark, ["a=1; Secure ;HTTPOnly"], web.cookie_flags(F.col("v"))) == [["a=1", "secure", "httponly"]]


def test_line_fixers(spark):
    cases = [
        ("PY006", "rules = yaml.load(handle)", "rules = yaml.safe_load(handle)"),
        ("PY006", "yaml.load(s, Loader=yaml.Loader)", None),
        ("PY009", "requests.put(link, verify = False)", "requests.put(link, verify=True)"),
        ("PY010", "server.run(debug=True)", "server.run(debug=False)"),
        ("PY013", "views(autoescape=False)", "views(autoescape=True)"),
        ("GO004", "tls.Config{InsecureSkipVerify :true}", "tls.Config{InsecureSkipVerify: false}"),
        ("SEC006", 'api_key = "hT6wq0Vz9LxB"  # x', 'api_key = os.environ["API_KEY"]  # x'),
        ("SEC006", 'x = 1; api_key = "hT6wq0Vz9LxB"', None),
        ("PY001", "eval(x)", None),
    ]
    got = column(spark, [(a, b) for a, b, _ in cases], fix.fix_line(F.col("r"), F.col("l")), "r string, l string")
    assert got == [c for *_, c in cases]
    line = 'dbToken: "hT6wq0Vz9LxB"'
    assert column(spark, [line], F.concat_ws("|", fix.secret_variable(F.col("v")), fix.secret_value(F.col("v")))) == ["DB_TOKEN|hT6wq0Vz9LxB"]


def test_entropy_counts_characters_of_long_and_odd_texts(spark):
    """Characters of several bytes, those with a meaning in patterns, and a long text."""
    texts = ["", None, "aaaa", "aéé\U0001f600", "ab" * 50_000, "\\$.*" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", t.shannon_entropy(F.col("t")).alias("bits"))
    for i, bits in rows.collect():
        text = texts[i]
        want = None if text is None else -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))
        assert bits == want or abs(bits - want) < 1e-9
