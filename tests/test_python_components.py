from srcweave.operators import components as CO
from srcweave.operators import resolve as RS
from srcweave.sources.corpus import parse_errors
from srcweave.sources.python_facts import python_facts

SHAPES = '''
import abc
class Base(metaclass=abc.ABCMeta):
    pass

@register("x")
class Shape(Base, Mixin, other.Trait):
    unit: str = "cm"
    _scale = 2

    def __init__(self, w, h=1):
        self.w = w
        if h:
            self._h = h
        self.w = 3

    @staticmethod
    def make(x: int, *rest, flag=True, **more) -> "Shape":
        return Shape(x)

    @classmethod
    def build(cls): pass

    async def _load(self): pass

def area(s: Shape, scale: float = 1.0) -> float:
    def inner(): return helper(s)
    return s.run() + helper(s)

def _helper(): pass

async def helper(x): pass
'''


def test_components_of_a_file(files):
    parsed = python_facts(files({"/p/lib/shapes.py": SHAPES}))
    rows = {(r.type, r.name): r for r in CO.components(parsed).collect()}
    assert set(rows) == {
        ("file", "shapes.py"), ("class", "Base"), ("class", "Shape"), ("function", "area"),
        ("function", "_helper"), ("function", "helper"),
    }
    file = rows["file", "shapes.py"]
    n = len(SHAPES.split("\n"))
    assert (file.start_line, file.end_line, file.metadata.loc) == (1, n, n)
    shape = rows["class", "Shape"].metadata
    assert shape.decorators == ['register("x")'] and shape.is_exported
    assert (shape.extends, shape.implements) == ("Base", ["Mixin", "other.Trait"])
    assert [(p.name, p.type, p.visibility) for p in shape.properties] == [
        ("unit", "str", "public"), ("_scale", "unknown", "private"), ("w", "unknown", "public"),
        ("_h", "unknown", "private"),
    ]
    methods = {m.name: m for m in shape.methods}
    assert methods["__init__"].visibility == "private"
    assert [(p.name, p.is_optional) for p in methods["__init__"].parameters] == [
        ("w", False), ("h", True)
    ]
    make = methods["make"]
    assert make.is_static and make.return_type == '"Shape"'
    assert [(p.name, p.type, p.is_optional) for p in make.parameters] == [
        ("x", "int", False), ("*rest", "unknown", True), ("flag", "unknown", True),
        ("**more", "unknown", True),
    ]
    assert methods["build"].is_static and methods["build"].parameters == []
    assert methods["_load"].is_async and methods["_load"].visibility == "private"
    assert rows["class", "Base"].metadata.extends is None
    area = rows["function", "area"].metadata
    assert area.return_type == "float" and area.is_exported
    assert not rows["function", "_helper"].metadata.is_exported


def test_broken_file_keeps_its_component_and_is_listed(files):
    parsed = python_facts(files({"/p/bad.py": "def (:\n", "/p/ok.py": "x = 1"}))
    assert [r.file_path for r in parse_errors(parsed).collect()] == ["/p/bad.py"]
    assert CO.components(parsed).count() == 2


def _edges(parsed):
    comps = CO.components(parsed)
    names = {r.id: r.name for r in comps.collect()}
    rows = RS.python_relationships(parsed, comps).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {(names[r.source], r.type, names[r.target]): r.import_specifiers for r in rows}


def test_relationships(files):
    parsed = python_facts(files({
        "/p/app/base.py": "class Model: pass\nclass Mixin: pass\ndef save(x): pass\n",
        "/p/app/user.py": (
            "from app.base import Model, Mixin as M\nfrom app.base import save\nimport os\n"
            "class User(Unknown, Model, Mixin):\n"
            "    def go(self):\n        save(self)\n        self.db.save(1)\n        User()\n"
        ),
        "/p/app/sub/deep.py": "from ..base import save\nfrom . import twin\nimport app.user as u, sys\n"
        "def run():\n    return [save(i) for i in x]\nsave(3)\n",
        "/p/app/sub/twin.py": "@save\ndef save2(): pass\n",
    }))
    assert _edges(parsed) == {
        ("user.py", "imports", "base.py"): ["Model", "Mixin"],
        ("deep.py", "imports", "base.py"): ["save"],
        ("deep.py", "imports", "twin.py"): ["twin"],
        ("deep.py", "imports", "user.py"): None,
        ("User", "extends", "Model"): None,
        ("User", "implements", "Mixin"): None,
        ("User", "calls", "save"): None,
        ("run", "calls", "save"): None,
    }


def test_names_resolve_to_the_last_path_of_the_same_project(files):
    body = "def util(): pass\ndef main():\n    util()\n"
    parsed = python_facts(files({"/p/a.py": body, "/p/b.py": body, "/q/z.py": "def util(): pass\n"}))
    comps = CO.components(parsed)
    path = {r.id: r.file_path for r in comps.collect()}
    targets = {path[r.target] for r in RS.call_edges(parsed, comps).collect()}
    assert targets == {"/p/b.py"}


def test_row_order_does_not_matter(files, spark):
    texts = {f"/p/m{i}.py": f"from m{(i * 3) % 7} import x\ndef f{i % 3}(): f{(i + 1) % 3}()\n"
             for i in range(12)}
    forward = _edges(python_facts(files(texts)))
    backward = _edges(python_facts(files(dict(reversed(texts.items())))))
    assert forward == backward
