import pytest

from srcweave.operators import findings as FN
from srcweave.operators import posture as PO
from srcweave.operators import taint as TN
from srcweave.operators.rules import RuleOptions, rules_table
from srcweave.sources.python_facts import python_facts


def taint_of(files, text, **kw):
    parsed = python_facts(files({"/p/a.py": text}))
    return {r.var: (r.source, r.path) for r in TN.taint_closure(parsed, **kw).collect()}


def body(*lines):
    return "def f(request):\n" + "".join(f"    {line}\n" for line in lines)


def test_taint_chain_and_labels(files):
    got = taint_of(files, body(
        'a = request.form["x"]', "b = a", 'c = f"q {b}"', 'd = "{}".format(c)', 'e = "x" + d',
        "g = e[0]", "h = wrap(g)", "k = 'safe'", "n, m = request.args['a'], 2", "t += a",
    ))
    assert got["a"] == ("request.form", ["request.form", "a"])
    assert got["c"][1] == ["request.form", "a", "b", "f-string", "c"]
    assert got["d"][1] == ["request.form", "a", "b", "f-string", "c", ".format()", "d"]
    assert got["e"][1][-2:] == ["d", "e"]
    assert got["g"][1][-2:] == ["e[0]", "g"]
    assert got["h"][1][-2:] == ["expression", "h"]
    assert got["t"][1] == ["request.form", "a", "t"]
    # The right side starts with a source, so every unpacked name is tainted.
    assert set(got) == set("abcdeghtnm")


def test_unpacking_needs_a_source_on_the_whole_right_side(files):
    assert set(taint_of(files, body("a, b = request.args"))) == {"a", "b"}
    assert taint_of(files, body("a, b = int(x), y")) == {}


def test_sanitizer_clears_and_order_counts(files):
    assert taint_of(files, body("a = request.GET['i']", "a = int(a)")) == {}
    assert set(taint_of(files, body("a = request.GET['i']", "b = a", "a = html.escape(a)"))) == {"b"}


def test_identifier_tokens_by_default_substrings_on_request(files):
    text = body("id = request.json", "valid = check(other_id)")
    assert set(taint_of(files, text)) == {"id"}
    assert set(taint_of(files, text, substring=True)) == {"id", "valid"}


def test_custom_source(files):
    assert set(taint_of(files, body("a = event.data.x"))) == set()
    assert set(taint_of(files, body("a = event.data.x"), custom_sources=("event.data",))) == {"a"}


CASES = [
    ("py-001", body("q = request.args['q']", 'db.execute(f"SELECT {q}")'), 1),
    ("py-001", body("q = request.args['q']", 'db.execute("SELECT ?", (q,))'), 0),
    ("py-001", body("q = 3", 'db.execute(f"SELECT {q}")'), 0),
    ("py-001", 'db.execute(f"SELECT {q}")\n', 1),
    ("py-001", body("q = request.args['q']", "execute(q)"), 0),
    ("py-002", body("c = input()", "os.system(c)"), 1),
    ("py-002", body("c = input()", 'os.system("ls")'), 0),
    ("py-002", body("c = input()", "subprocess.run(c)"), 0),
    ("py-002", body("c = input()", "subprocess.run(c, shell=True)"), 1),
    ("py-002", body("c = input()", "subprocess.call(c)"), 1),
    ("py-003", body("p = request.args['p']", "open(p)"), 1),
    ("py-003", body("p = request.args['p']", "q = os.path.abspath(p)", "open(p)"), 0),
    ("py-003", body("p = request.args['p']", "x = Path(p).resolve()", "open(p)"), 0),
    ("py-003", body("open('a.txt')"), 0),
    ("py-004", 'password = "hunter22"\n', 1),
    ("py-004", 'db_password = "hunter22"\n', 0),
    ("py-004", 'password = "x"\n', 0),
    ("py-004", 'password = "<your password>"\n', 0),
    ("py-004", 'password = os.environ["PW"]\n', 0),
    ("py-004", 'cfg.secret = "abcdefgh"\n', 1),
    ("py-005", "x = pickle.loads(b)\n", 1),
    ("py-005", "x = yaml.load(b, Loader=yaml.SafeLoader)\n", 0),
    ("py-005", "x = yaml.load(b)\n", 1),
    ("py-006", '@app.route("/x")\ndef v(): pass\n', 1),
    ("py-006", '@app.route("/x")\n@login_required\ndef v(): pass\n', 0),
    ("py-006", '@app.route("/health")\ndef v(): pass\n', 0),
    ("py-006", '@permission_required("a")\n@r.post("/x")\ndef v(): pass\n', 0),
    ("py-006", "@cached\ndef v(): pass\n", 0),
]


def test_rules_fire_and_stay_quiet(files):
    texts = {f"/p/case{i:02}.py": text for i, (_, text, _) in enumerate(CASES)}
    found = FN.findings(python_facts(files(texts))).collect()
    got = [
        sum(r.file_path == f"/p/case{i:02}.py" and r.rule_id == rule for r in found)
        for i, (rule, _, _) in enumerate(CASES)
    ]
    assert got == [n for _, _, n in CASES]


def test_two_hits_on_one_line_share_an_id_but_not_the_hit_number(files):
    parsed = python_facts(files({"/p/a.py": "x = [pickle.loads(a), pickle.loads(b)]\n"}))
    rows = FN.findings(parsed).collect()
    assert len(rows) == 2 and len({r.id for r in rows}) == 1 and len({r.hit_no for r in rows}) == 2


@pytest.fixture
def mixed(files):
    return python_facts(files({
        "/p/a.py": 'password = "hunter22"\nx = pickle.loads(b)\n',
        "/p/b.py": '@app.route("/x")\ndef v(): pass\n', "/q/c.py": "y = 1\n",
    }))


def test_options(mixed):
    def ids(options):
        return sorted((r.rule_id, r.severity) for r in FN.findings(mixed, options=options).collect())

    assert ids(RuleOptions()) == [("py-004", "medium"), ("py-005", "critical"), ("py-006", "medium")]
    assert ids(RuleOptions(disabled=frozenset({"py-005"}))) == [
        ("py-004", "medium"), ("py-006", "medium")]
    assert ids(RuleOptions(severity={"py-004": "high"}, min_severity="high")) == [
        ("py-004", "high"), ("py-005", "critical")]
    assert ids(RuleOptions(false_positives=("^pass",))) == [
        ("py-005", "critical"), ("py-006", "medium")]


def test_config_table_equals_options(mixed, spark):
    config = spark.createDataFrame(
        [("py-005", False, None), ("py-004", True, "low")],
        "rule_id string, enabled boolean, severity string",
    )
    by_table = FN.apply_rule_config(FN.findings(mixed), config)
    assert sorted((r.rule_id, r.severity) for r in by_table.collect()) == [
        ("py-004", "low"), ("py-006", "medium")]


def test_posture_covers_clean_projects(mixed, spark):
    projects = spark.createDataFrame([("p",), ("q",)], "project_id string")
    found = FN.findings(mixed)
    rows = {r.project_id: r for r in PO.posture(found, projects).collect()}
    assert (rows["p"].score, rows["p"].grade, rows["p"].total) == (59, "F", 3)
    assert (rows["q"].score, rows["q"].grade) == (100, "A")
    assert rows["q"].summary.startswith("No security findings")
    assert rows["p"].summary == (
        "Found 3 security issues: 1 critical, 0 high, 2 medium, 0 low. Score: 59/100 (F).")
    gate = {r.project_id: r.exit_code for r in PO.security_gate(found, projects, "high").collect()}
    assert gate == {"p": 2, "q": 0}


def test_all_rules_are_listed_even_when_disabled(spark):
    assert rules_table(spark, "python").count() == 6
    assert rules_table(spark, "typescript").count() == 7
    assert rules_table(spark).count() == 13


def test_diffs(files, spark):
    before = FN.findings(python_facts(files({"/p/a.py": 'password = "hunter22"\nx = pickle.loads(b)\n'})))
    after = FN.findings(python_facts(files({"/p/a.py": 'password = "hunter22"\n\nx = pickle.loads(b)\n'})))
    status = sorted(r.status for r in FN.findings_diff(before, after).collect())
    assert status == ["fixed", "new", "unchanged"]
    assert FN.new_findings(before, after).count() == 1
