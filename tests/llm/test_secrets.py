"""The lexer of secrets: every form of assignment, scopes, and linear time."""

import time

import pytest

from lexiqua.llm import secrets

S = "k9Xw2LmQ7v1Z"


def parts(text):
    return [text[a:b] for a, b, _ in secrets.lexed_spans(text, [])]


@pytest.mark.parametrize(
    "text",
    [
        f'db_pwd = "{S}"', f"db_pwd = '{S}'", f'db_pwd = """{S}"""', f"db_pwd = '''{S}'''", f"const dbPwd = `{S}`;", f"db_pwd = b'{S}'", f'db_pwd = rb"{S}"',
        f"db_pwd: |\n  {S}\nnext: 1", f"a:\n  db_pwd: >-\n    {S}\n  b: 2", f"db:\n  pwd: {S}", f'{{"db_pwd": "{S}"}}', f"[db]\npwd={S}\n", f"export DB_PWD={S}",
        f"<db_pwd>{S}</db_pwd>", f'<x:db_pwd a="1"> {S} </x:db_pwd>', f'<add key="db_pwd" value="{S}"/>', f'- name: DB_PWD\n  value: "{S}"', f"postgres://bob:{S}@host/db",
        f'user, db_pwd = "bob", "{S}"', f'(user, db_pwd) = ("bob", "{S}")', f'db_pwd = os.getenv("DB", "{S}")', f'db_pwd = os.environ.get("DB") or "{S}"',
        f'const dbPwd = process.env.PWD || "{S}"', f'db_pwd = SecretStr("{S}")', f"'pwd' => '{S}',", f'db_pwd := "{S}"', f'db_pwd = (\n  "{S}"\n)',
        "".join(f"a{i} = " for i in range(40)) + f'db_pwd = "{S}"', f'x = db_pwd{" = y" * 30} = "{S}"', f"db_pwd: Map<{'x, ' * 200}y> = \"{S}\"", f'db_pwd: {"a | " * 50}b = "{S}"',
        f"x={S}\ndb_pwd=${{x}}", f"db_pwd: '{S}' # it's", f"don't say: it\ndb_pwd = '{S}'", f'x = "{S}"\ndb_pwd = x\nx = "hello there"',
    ],
)
def test_forms_of_assignment(text):
    assert parts(text) == [S]


@pytest.mark.parametrize(
    "text, found",
    [
        ('db_pwd = "k9Xw\\"2LmQ7v1Z"', ['k9Xw\\"2LmQ7v1Z']), ('db_pwd = "k9Xw 2LmQ7v1Z"', ["k9Xw 2LmQ7v1Z"]), ('db_pwd = "k9Xw#2LmQ7@v1Z"', ["k9Xw#2LmQ7@v1Z"]),
        ("db_pwd=k9Xw#2LmQ7@v1Z", ["k9Xw#2LmQ7@v1Z"]), ('db_pwd = "k9Xw2L" "mQ7v1Z"', ["k9Xw2L", "mQ7v1Z"]), ('db_pwd = "k9Xw2L" \\\n  "mQ7v1Z"', ["k9Xw2L", "mQ7v1Z"]),
        ('db_pwd = ("k9Xw2L" +\n   "mQ7v1Z")', ["k9Xw2L", "mQ7v1Z"]), ('db_pwd = "k9Xw2L" +\n   "mQ7v1Z"', ["k9Xw2L", "mQ7v1Z"]), ("db_pwd: |\n  k9Xw2L\n  mQ7v1Z\nx: 1", ["k9Xw2L", "mQ7v1Z"]),
    ],
)
def test_literals_and_their_parts(text, found):
    assert parts(text) == found


@pytest.mark.parametrize(
    "text",
    [
        'db_pwd = os.getenv("DATABASE_PWD_1")', 'db_pwd = getpass("Password 12 please")', "the key: it's a token of don't 'x", 'db_pwd = "please ask bob for it 2 times"',
        f'def f():\n    x = "{S}"\ndef g():\n    db_pwd = x\n', 'db_pwd == "k9Xw2LmQ7v1Z"', 'if db_pwd != "k9Xw2LmQ7v1Z":', "db_pwd = load(path)", 'db_pwd = "changeme-please1"',
    ],
)
def test_no_secrets(text):
    assert parts(text) == []


def test_later_definition_of_the_same_or_an_outer_scope():
    assert parts(f'def f():\n    db_pwd = x\nx = "{S}"') == [S]
    assert parts(f'db_pwd = x\ndef f():\n    x = "{S}"') == []


@pytest.mark.parametrize(
    "text",
    [
        "a = " * 80_000, "a=" * 150_000, "a: b | " * 40_000, "a: b[" * 60_000, "=" * 300_000, '\\"' * 100_000, '"' * 100_001, "a=(" * 50_000, "a=f(" * 50_000, "a=f(x," * 50_000,
        "".join(" " * i + "a: |\n" for i in range(700)), "a," * 50_000 + "=1", "a = b or " * 30_000, "a = b + " * 30_000, 'a = "b" + ' * 30_000, "<a " * 60_000, "<a>b" * 60_000,
        "://a:b" * 50_000, '"""a' * 30_001, "a=${" * 30_000, 'a["b"]=' * 30_000, "a = " + '"b" ' * 60_000, '"b" = ' * 30_000, "x = 1 +\n" * 30_000, "a = b\n" * 50_000,
    ],
)
def test_linear_time(text):
    start = time.perf_counter()
    secrets.scan([text])
    # a pass in squared time takes minutes on these
    assert time.perf_counter() - start < 15


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, f'db_pwd = "{S}"'), (3, f'db_pwd = "{S}"'), (None, "é = \n"), (4, "x" * 2_000_000 + f'\ndb_pwd = "{S}"')]
    table = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, n_hex int, spans string")
    got = sorted((tuple(r) for r in secrets.secrets(table).select("doc_id", "n_lexed", "spans").collect()), key=str)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (3, 1, "lexed:10:22"), (3, 1, "lexed:10:22"), (None, 0, ""), (4, 1, "lexed:2000011:2000023")], key=str)
    assert secrets.secrets(table.limit(0)).count() == 0
