"""Uses in Python scripts: scopes, rebinding, contexts, annotations, calls on fresh instances."""

from __future__ import annotations

from corpusloom.operators import scopes
from corpusloom.sources.tables import stored

SCRIPT = """import app.db as db
from app.models import User, make_user, lowClient
import os.path

def outer(user: User, plain):
    user.save(1, force=True)
    plain.nothing()
    def inner():
        user.age
        late.go()
    class Own:
        user = 3
        user.no()
        def m(self):
            user.inside()
    return inner

u = User("a")
u.first()
u = 5
u.gone()
u = User.load(3)
u.unknown()
x: User = make_user()
x: User = User()
x.bye()
y: User
y.hint = 1
with User() as v, db.open("f") as w:
    v.go()
    w.no()
User().hi().more()
late = User()
a, b = User(), 7
a.pair()
b.none()
for u in [1]:
    u.loop()
os.path.join("a", *rest)
c = lowClient()
c.send()
print(db.connect(u.z, User.LIMIT))
f = lambda q: q.no() or late.lam()
copy = late
copy.again()
async def go():
    async with User() as z:
        await z.wait()
"""


def test_uses_follow_scopes_and_bindings(spark):
    files = spark.createDataFrame([("a", SCRIPT), ("b", "x ===="), ("c", None), ("d", "")], "path string, content string")
    rows = scopes.uses(files, stored).collect()
    got = sorted((r.kind, r.owner, r.name, r.n_args, tuple(r.kwargs), r.line) for r in rows if r.path == "a" and r.kind != "import")
    line = {t: i for i, text in enumerate(SCRIPT.split("\n"), 1) for t in (text,)}
    at = lambda part: next(i for t, i in line.items() if part in t)
    user = "app.models.User"
    want = [
        ("method", user, "save", 1, ("force",), at("user.save")), ("attribute", user, "age", 0, (), at("user.age")), ("method", user, "go", 0, (), at("late.go")), ("method", user, "inside", 0, (), at("user.inside")),
        ("class", "app.models", "User", 1, (), at('User("a")')), ("method", user, "first", 0, (), at("u.first")), ("method", user, "load", 1, (), at("User.load")), ("function", "app.models", "make_user", 0, (), at("make_user()")),
        ("class", "app.models", "User", 0, (), at("x: User = User()")), ("method", user, "bye", 0, (), at("x.bye")), ("attribute", user, "hint", 0, (), at("y.hint")),
        ("class", "app.models", "User", 0, (), at("with User()")), ("function", "app.db", "open", 1, (), at("with User()")), ("method", user, "go", 0, (), at("v.go")),
        ("class", "app.models", "User", 0, (), at("User().hi()")), ("method", user, "hi", 0, (), at("User().hi()")), ("class", "app.models", "User", 0, (), at("late = User()")),
        ("class", "app.models", "User", 0, (), at("a, b = ")), ("method", user, "pair", 0, (), at("a.pair")), ("function", "os.path", "join", 1, (), at("os.path.join")),
        ("class", "app.models", "lowClient", 0, (), at("lowClient()")), ("method", "app.models.lowClient", "send", 0, (), at("c.send")), ("function", "app.db", "connect", 2, (), at("db.connect")), ("attribute", user, "LIMIT", 0, (), at("db.connect")),
        ("method", user, "lam", 0, (), at("late.lam")), ("method", user, "again", 0, (), at("copy.again")), ("class", "app.models", "User", 0, (), at("async with")), ("method", user, "wait", 0, (), at("z.wait")),
    ]
    assert got == sorted(want)
    assert sorted((r.owner, r.name) for r in rows if r.path == "a" and r.kind == "import") == [("app.db", ""), ("app.models", "User"), ("app.models", "lowClient"), ("app.models", "make_user"), ("os.path", "")]
    assert [r.kind for r in rows if r.path in "bcd"] == ["error"]


def test_resolving_joins_nothing_back(spark):
    """What is asked travels with its name, repeated rows and those without scopes too, so the plan has no join."""
    asked = spark.createDataFrame([("p", 1, [1, 0], "u", 5, "x"), ("p", 1, [1, 0], "u", 5, "x"), ("p", 2, [0], "u", 1, "y"), ("p", 3, [], "u", 9, "z")], "path string, id bigint, scopes array<int>, name string, at bigint, rest string")
    bound = spark.createDataFrame([("p", 0, "u", 7, "m.X"), ("p", 0, "u", 8, "m.Y")], "path string, scope int, name string, at bigint, full string")
    out = scopes._resolved(asked, bound)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.rest, r.full or "") for r in out.collect()) == [(1, "x", "m.X"), (1, "x", "m.X"), (2, "y", ""), (3, "z", "")]


def test_each_content_is_parsed_once(spark):
    """Equal scripts share their events, unknown names have none, only events are written, and each path gets its uses."""
    held = {}

    def work(df, name):
        held[name] = stored(df, name)
        return held[name]

    script = "from m import X\na = X()\nwith a as b:\n    b.go()\nprint(len(q.r))\nn = q.s()\nn.no()\n"
    files = spark.createDataFrame([(f"p{i}", script) for i in range(50)] + [("p0", script), ("e1", "x ==="), ("e2", "x ==="), (None, script), ("n", None)], "path string, content string")
    rows = scopes.uses(files, work).collect()
    assert sorted((r.event, r.name) for r in held["events"].collect()) == [("bind", "X"), ("bind", "a"), ("bind", "b"), ("error", ""), ("import", "m"), ("use", "X"), ("use", "b")]
    assert list(held) == ["events"]
    want = [("class", "m", "X", 2), ("import", "m", "X", 1), ("method", "m.X", "go", 4)]
    for path in ("p0", "p49"):
        assert sorted((r.kind, r.owner, r.name, r.line) for r in rows if r.path == path) == sorted(want * (2 if path == "p0" else 1))
    assert len(rows) == 51 * 3 + 2 and {r.path for r in rows if r.kind == "error"} == {"e1", "e2"}
    # more contents than are broadcast
    before, scopes.SENT = scopes.SENT, 3
    try:
        assert sorted(map(str, scopes.uses(files, stored).collect())) == sorted(map(str, rows))
    finally:
        scopes.SENT = before
