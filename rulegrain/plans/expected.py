"""What the Python templates hold, fact by fact: fixed values, listed once by a plain walk of the templates.

Each row begins with the number of the template in ``derive.PY``, line and column. The tables are what the
queries over facts are checked with, so that every fact of every file has an expected row.
"""

# Name, attribute, keywords (``name=True|False|-`` and ``/safe``), arguments, first one builds text, second one names Safe.
CALLS = [
    (0, 1, 9, 'eval', None, '', 1, False, None),
    (1, 1, 1, 'exec', None, '', 2, False, False),
    (2, 3, 12, 'os.system', 'system', '', 1, True, None),
    (3, 2, 6, 'subprocess.Popen', 'Popen', 'stdin=- shell=True', 1, False, None),
    (3, 3, 5, 'child.wait', 'wait', '', 0, False, None),
    (3, 4, 1, 'subprocess.run', 'run', 'shell=-', 1, False, None),
    (4, 2, 9, 'pickle.load', 'load', '', 1, False, None),
    (4, 3, 1, 'pickle.loads', 'loads', '', 1, False, None),
    (5, 2, 21, 'yaml.load', 'load', '', 1, False, None),
    (5, 2, 31, 'open', None, '', 1, False, None),
    (6, 2, 8, 'list', None, '', 1, False, None),
    (6, 2, 13, 'yaml.load_all', 'load_all', '', 1, False, None),
    (6, 3, 9, 'yaml.load', 'load', '', 2, False, False),
    (6, 4, 8, 'yaml.load', 'load', 'Loader=-/safe', 1, False, None),
    (6, 4, 31, 'pick', None, '', 1, False, None),
    (7, 2, 9, 'sorted', None, '', 1, False, None),
    (7, 2, 16, 'hashlib.md5', 'md5', '', 1, False, None),
    (7, 2, 16, 'hexdigest', 'hexdigest', '', 0, False, None),
    (8, 2, 5, 'conn.cursor', 'cursor', '', 0, False, None),
    (8, 2, 5, 'execute', 'execute', '', 1, True, None),
    (8, 3, 1, 'conn.executescript', 'executescript', '', 1, True, None),
    (8, 4, 1, 'conn.executemany', 'executemany', '', 2, True, False),
    (8, 5, 1, 'log.execute', 'execute', '', 1, True, None),
    (8, 5, 13, 'sql.format', 'format', '', 1, False, None),
    (9, 2, 1, 'requests.put', 'put', 'data=- verify=False', 1, False, None),
    (10, 1, 1, 'server.run', 'run', 'port=- debug=True host=-', 0, False, None),
    (11, 2, 1, 'extractall', 'extractall', '', 0, False, None),
    (11, 2, 1, 'zipfile.ZipFile', 'ZipFile', '', 1, False, None),
    (12, 2, 8, 'tempfile.mktemp', 'mktemp', '', 1, False, None),
    (13, 2, 9, 'jinja2.Environment', 'Environment', 'loader=- autoescape=False', 0, False, None),
    (17, 4, 34, 'len', None, '', 1, False, None),
    (18, 1, 7, 'eval', None, '', 1, False, None),
    (19, 4, 1, 'requests.get', 'get', 'verify=False', 1, False, None),
    (19, 5, 1, 'requests.get', 'get', 'verify=False', 1, False, None),
    (20, 3, 1, 'yaml.load', 'load', '', 1, False, None),
    (20, 3, 15, 'yaml.load', 'load', '', 1, False, None),
    (21, 1, 1, 'eval', 'eval', '', 1, False, None),
    (21, 1, 1, 'get', None, '', 0, False, None),
    (21, 2, 1, 'self.app.run', 'run', 'debug=True', 0, False, None),
    (23, 2, 3, 'requests.patch', 'patch', 'verify=False', 1, False, None),
    (24, 1, 1, 'requests.head', 'head', 'verify=False', 1, False, None),
    (24, 14, 1, 'requests.head', 'head', 'verify=False', 1, False, None),
    (24, 20, 1, 'requests.head', 'head', 'verify=False', 1, False, None),
]

# Name, a string that is not blank, a list with a star, True itself.
ASSIGNS = [
    (0, 1, 1, 'total', False, False, False),
    (2, 3, 5, 'code', False, False, False),
    (4, 2, 1, 'state', False, False, False),
    (5, 2, 1, 'merged', False, False, False),
    (6, 2, 1, 'docs', False, False, False),
    (6, 3, 1, 'first', False, False, False),
    (6, 4, 1, 'last', False, False, False),
    (7, 2, 1, 'names', False, False, False),
    (12, 2, 1, 'part', False, False, False),
    (13, 2, 1, 'views', False, False, False),
    (14, 1, 1, 'SECRET_KEY', True, False, False),
    (15, 1, 1, 'DEBUG', False, False, True),
    (15, 2, 1, 'ALLOWED_HOSTS', False, True, False),
    (15, 3, 1, 'DEBUG', False, False, False),
    (17, 2, 5, 'limit', False, False, False),
    (19, 3, 1, 'auth_token', True, False, False),
    (20, 2, 1, 'mailPassword', True, False, False),
    (24, 2, 1, 'x', False, False, False),
    (24, 3, 1, 'x', False, False, False),
    (24, 4, 1, 'x', False, False, False),
    (24, 5, 1, 'x', False, False, False),
    (24, 6, 1, 'x', False, False, False),
    (24, 7, 1, 'x', False, False, False),
    (24, 8, 1, 'x', False, False, False),
    (24, 9, 1, 'x', False, False, False),
    (24, 10, 1, 'x', False, False, False),
    (24, 11, 1, 'x', False, False, False),
    (24, 12, 1, 'x', False, False, False),
    (24, 13, 1, 'x', False, False, False),
    (24, 15, 1, 'y', False, False, False),
    (24, 16, 1, 'y', False, False, False),
    (24, 17, 1, 'y', False, False, False),
    (24, 18, 1, 'y', False, False, False),
    (24, 19, 1, 'y', False, False, False),
]

# The text.
CONSTS = [
    (2, 3, 24, 'ping -c1 '),
    (6, 4, 36, 'CSafeLoader'),
    (8, 2, 29, 'ANALYZE '),
    (8, 3, 20, 'VACUUM '),
    (8, 4, 18, '%s'),
    (10, 1, 38, '0.0.0.0'),
    (12, 2, 24, '.part'),
    (14, 1, 14, 'k3y-of-tests-0f9e8d7c'),
    (15, 2, 18, '*'),
    (18, 1, 1, 'ü'),
    (19, 3, 14, 'hT6wq0Vz9LxB'),
    (20, 2, 16, 'Tq8_vR!2mZx7Lw0'),
]


def values(rows: list[tuple]) -> str:
    """Rows as a list of SQL values."""

    def spelt(x) -> str:
        if x is None or isinstance(x, bool):
            return {None: "NULL", True: "true", False: "false"}[x]
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(spelt, row)) + ")" for row in rows)
