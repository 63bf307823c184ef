import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cutline.functions import columns as C
from cutline.operators import decisions as D
from cutline.operators import ingest, matching, records
from cutline.operators.rules import Baskets, basket_rule, compile_rule, counted_gate, rule_gate

SUBJECTS = "id int, subjects array<struct<subject:string,grade:string>>, stream string"


def judge(spark, rule, subjects, stream="S1"):
    df = spark.createDataFrame([(1, subjects, stream)], SUBJECTS)
    return df.select(compile_rule(rule, F.col("subjects"), F.col("stream"))).first()[0]


@pytest.mark.parametrize(
    "rule, expected",
    [
        (None, True),
        ({"type": "and", "conditions": []}, True),
        ({"type": "or", "conditions": []}, False),
        ({"type": "stream_is", "streams": ["S1", "S2"]}, True),
        ({"type": "subject_min_grade", "subject": "math", "min_grade": "B"}, True),
        ({"type": "subject_min_grade", "subject": "math", "min_grade": "A"}, False),
        ({"type": "one_of_min_grade", "subjects": ["art", "law"]}, True),
        ({"type": "count_from_list", "subjects": ["math", "art", "bio"], "count": 3}, False),
        ({"type": "count_from_list", "subjects": ["math", "art", "bio"], "count": 2, "min_grade": "C"}, False),
        ({"type": "any_n_subjects", "count": 2}, True),
        ({"type": "and", "conditions": [{"type": "any_n_subjects", "count": 1}, {"type": "or", "conditions": []}]}, False),
    ],
)
def test_rules(spark, rule, expected):
    assert judge(spark, rule, [("math", "b"), ("art", "S"), ("bio", "F")]) is expected


def test_rule_errors(spark):
    with pytest.raises(ValueError):
        judge(spark, {"type": "odd"}, [])
    with pytest.raises(Exception, match="unknown grade"):
        judge(spark, {"type": "any_n_subjects", "count": 1}, [("math", "X")])


BASKETS = Baskets(("core",), ("r1", "c1", "r2"), (("r1", "c1"),), (("a1", "a2"), ("b1",)), ("n1", "n2", "n3"), ("k1", "k2", "k3"), ("f1", "f2", "f3"))


@pytest.mark.parametrize(
    "names, expected",
    [
        (["core", "r1", "a1"], True), (["core", "r1"], False), (["r1", "c1", "core"], False), (["a1", "a2", "core"], False), (["n1", "n2", "n3"], True),
        (["k1", "k2", "k3"], False), (["n1", "k1", "k2"], True), (["n1", "n2", "f1"], False), (["n1", "f1", "r1"], True), (["r1", "r2", "a1"], False), (["core", "n1", "f1"], True),
    ],
)
def test_baskets(spark, names, expected):
    df = spark.createDataFrame([(1, [(n, "S") for n in names], "")], SUBJECTS)
    assert df.select(basket_rule(F.col("subjects"), BASKETS)).first()[0] is expected
    failed = spark.createDataFrame([(1, [(n, "?") for n in names], "")], SUBJECTS)
    assert failed.select(basket_rule(F.col("subjects"), BASKETS)).first()[0] is False


def test_margin_is_rounded_before_its_sign(spark):
    rows = [(i, Decimal(z), Decimal("1.5000")) for i, z in enumerate(["1.49996", "1.4999", "1.5", "1.65", "1.34996", "1.3499"])]
    df = spark.createDataFrame(rows, "id int, z decimal(12,8), cutoff decimal(6,4)")
    got = {r.id: (r.status, r.is_marginal) for r in D.decide(df, "z", "cutoff", 0.15, 0.05, F.lit(False)).collect()}
    assert got == {0: ("eligible", True), 1: ("near_miss", False), 2: ("eligible", True), 3: ("eligible", False)}


def test_effective_period(spark):
    facts = spark.createDataFrame([(2020,), (2022,)], "y int")
    profiles = spark.createDataFrame([(1, 2020), (2, 2023), (3, 2030), (4, None)], "id int, wanted int")
    got = {r.id: (r.used_period, r.tier, r.note) for r in D.effective_period(profiles, facts, "wanted", "y").collect()}
    assert got == {1: (2020, "current", None), 2: (2022, "previous_year", "no data for 2023, 2022 used"), 3: (2022, "estimated", "no data for 2030, 2022 used"), 4: (2022, "current", None)}


def test_scoring_renormalises(spark):
    config = D.Scoring({"a": 0.5, "b": 0.3, "c": 0.2})
    df = spark.createDataFrame([(1, 0.8, None, 0.5), (2, None, None, None)], "id int, a double, b double, c double")
    got = {r.id: r.t for r in df.select("id", D.weighted_total(config).alias("t")).collect()}
    assert got[1] == pytest.approx(0.5 / 0.7 * 0.8 + 0.2 / 0.7 * 0.5, abs=1e-4) and got[2] == 0
    parts = df.where("id = 1").select(D.breakdown(config).alias("b")).first().b
    assert [p.name for p in parts] == ["a", "c"] and sum(p.weight for p in parts) == pytest.approx(1, abs=1e-3)


def test_scores(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    tags = lambda *x: F.array(*map(F.lit, x))
    assert get(D.margin_score(F.lit(0.0))) == 0.5
    assert get(D.similarity_score(F.lit(0.45))) == 0 and get(D.similarity_score(F.lit(1.0))) == pytest.approx(1)
    assert get(D.place_score(F.lit(1), F.lit(2), F.array().cast("array<int>"), F.lit(2))) is None
    assert get(D.tag_score(tags("data", "law"), tags("big data"))) == 0.5
    assert get(D.demand_score(tags("x"), tags("it"), {"it": 0.9})) == 0
    assert get(D.demand_score(F.array().cast("array<string>"), tags("it"), {"it": 0.9})) == 0.9


def test_catalog_diff(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, None), ("d", 1, 1.0)], "k string, m int, v double")
    new = spark.createDataFrame([("a", 1, 1.0001), ("c", 1, 2.0), ("d", 1, 1.0), ("e", 1, 0.0)], "k string, m int, v double")
    got = {r.k: (r.kind, r.changed) for r in D.catalog_diff(old, new, "k", "m", "v").collect()}
    assert got == {"a": ("changed", 1), "b": ("removed", 1), "c": ("changed", 1), "d": ("same", 0), "e": ("added", 1)}


def test_hosts_of_malformed_urls(spark):
    """No URL ends a query: what has no authority has an empty host."""
    urls = ["http://exa mple.com/a", "http://a.org/x|y", "http://a.org/%zz", "HTTP://User@WWW.A.org:80/p", "mailto:x@y", "", None, "//b.org", "https://www.ww.net?x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(C.host(F.col("url"))).collect()] == ["exa mple.com", "a.org", "a.org", "a.org", "", "", "", "", "net"]
    results = df.select("url", F.lit(0).alias("source"), F.monotonically_increasing_id().alias("at"))
    assert [r.score for r in matching.trusted_first(results, "url", "source", "at", ["a.org"], [".com"], 9).collect()][:4] == [2, 2, 2, 1]


def test_states_of_runs(spark):
    names = ["running", "needs_pages", "needs_mapping", "failed", "success", "partial"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    moved = {(r.a, r.b) for r in df.select("a", "b", records.next_state(F.col("a"), F.col("b")).alias("now")).collect() if r.now == r.b != r.a}
    assert {a for a, b in moved if b == "running"} == {"needs_pages", "needs_mapping", "failed"}
    assert not {a for a, _ in moved} & {"success", "partial"}


def test_versions_and_unknown_codes(spark):
    old = spark.createDataFrame([(1, "a", 3), (2, None, 3), (3, None, 2), (4, "x", 1)], "k int, content string, version int")
    new = spark.createDataFrame([(1, None), (2, "b"), (3, None), (4, "x"), (5, None)], "k int, content string")
    assert {r.k: r.version for r in ingest.version_bump(old, new, "k").collect()} == {1: 4, 2: 4, 3: 2, 4: 1, 5: 1}
    with pytest.raises(Exception, match="unknown code: zz"):
        records.resolve_codes(spark.createDataFrame([("zz",), (None,)], "code string"), "code", old, "content", "k", "id").collect()
    held = spark.createDataFrame([(1, True), (2, False)], "k int, is_active boolean")
    assert [[r.is_active for r in ingest.exclusive_activation(held, "k", c).orderBy("k").collect()] for c in (2, 9)] == [[False, True], [True, False]]
    twice = spark.createDataFrame([("ab", "y"), ("ab", "x"), ("a", "z")], "prefix string, mark string")
    assert records.longest_prefix(spark.createDataFrame([("abc",)], "text string"), "text", twice, "prefix", "mark").first()["mark"] == "x"


def test_card_of_a_promoted_year(spark):
    active = spark.createDataFrame([(f"c{i:02}",) for i in range(20)], "code string")
    facts = spark.createDataFrame([(2034, "c03"), (2033, "c04"), (2034, "c03")], "year int, code string")
    rows = spark.createDataFrame([(2034,), (2033,)], "year int")
    added = spark.createDataFrame([("n1", True), ("n2", False), ("n3", None)], "code string, ready boolean")
    card = records.promote_card(2034, active, "code", facts, rows, rows, added, F.col("ready")).first()
    assert (card.promoted_year, card.students_now_see, card.is_default_year, card.coverage_gap_count, card.stream_override_rows, card.codeless_rows) == (2034, 2034, True, 19, 1, 1)
    assert card.coverage_gaps == [f"c{i:02}" for i in range(16) if i != 3] and (card.new_total, card.new_onboarded, card.new_pending) == (3, 1, ["n2", "n3"])
    old = records.promote_card(2033, active, "code", facts, rows, rows, added.limit(0), F.col("ready")).first()
    assert not old.is_default_year and old.new_total == 0 and old.new_pending == []
    assert records.promote_card(2034, active, "code", facts.limit(0), rows, rows, added, F.col("ready")).first().is_default_year is False


def test_lists_of_profiles(spark):
    """Without a preference the highest cutoff comes first; with one the score decides. What is offered without a cutoff comes by key."""
    rows = [(p, k, c, m, u, st) for p in (1, 2) for k, c, m, u, st in (("a", 1.0, 0.5, "X", "eligible"), ("b", 1.4, 0.1, "Y", "conditional"), ("c", 1.2, 0.3, "Z", "eligible"), ("d", 1.6, -0.1, "X", "near_miss"))]
    judged = spark.createDataFrame(rows, "profile int, code string, cutoff double, margin double, uni string, status string").withColumn("passes", F.col("code") != "z").withColumn("wish", F.when(F.col("profile") == 2, F.array(F.lit("X"))))
    dimensions = [("z_margin", lambda: D.margin_score(F.col("margin"))), ("university", lambda: D.place_score(F.col("uni"), F.lit(1), F.col("wish"), F.lit(2)))]
    got = D.recommend_profiles(judged, "profile", dimensions, D.Scoring({"z_margin": 0.5, "university": 0.5}), F.size("wish") > 0, "cutoff", "code", 2)
    lists = {p: [(r.code, r["mode"], r.n_all) for r in got.where(f"profile = {p}").orderBy("place").collect()] for p in (1, 2)}
    assert lists == {1: [("b", "normal", 3), ("c", "normal", 3)], 2: [("a", "preference", 3), ("c", "preference", 3)]}
    assert {tuple(b.name for b in r.breakdown) for r in got.where("profile = 1").collect()} == {("z_margin",)}
    also = D.also_offered(judged.select("profile", "code"), judged.where("code IN ('a', 'c')").select("code"), ["code"], "profile", "code", 1).collect()
    assert sorted((r.profile, r.code, r.n_all) for r in also) == [(1, "b", 2), (2, "b", 2)]


def test_active_config(spark):
    rows = [(1, True, {"z_margin": 1.0}, {"safe_score": 0.5, "safe_margin": 0.2}), (3, False, {"z_margin": 0.1}, {}), (2, True, {"z_margin": 0.7, "interest": 0.3}, {"safe_score": 0.6, "safe_margin": 0.1})]
    configs = spark.createDataFrame(rows, "version int, is_active boolean, weights map<string,double>, thresholds map<string,double>")
    default = D.Scoring({"z_margin": 1.0})
    found = D.active_config(configs, default)
    assert found.weights == {"z_margin": 0.7, "interest": 0.3} and found.thresholds["safe_score"] == 0.6
    assert D.active_config(configs.where("version = 3"), default) is default


def test_counted_rules_equal_compiled_ones(spark):
    rules = {
        "k1": {"type": "and", "conditions": [{"type": "any_n_subjects", "count": 2}, {"type": "one_of_min_grade", "subjects": ["x", "y"], "min_grade": "C"}]},
        "k2": {"type": "or", "conditions": [{"type": "subject_min_grade", "subject": "z", "min_grade": "B"}, {"type": "stream_is", "streams": ["S1"]}]},
        "k3": {"type": "count_from_list", "subjects": ["x", "z"], "count": 2, "min_grade": "S"}, "k4": {"type": "and", "conditions": []},
    }
    rng = random.Random(1)
    rows = [(i, f"k{i % 5}", f"S{i % 2}", [(rng.choice("xyz"), rng.choice("FSCBAa")) for _ in range(rng.randint(0, 4))]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, stream string, subjects array<struct<subject:string,grade:string>>")
    each = df.select("id", F.explode("subjects").alias("s"))
    counts, gate = counted_gate(F.col("k"), rules, F.col("s.subject"), F.col("s.grade"), F.col("stream"))
    got = df.join(each.groupBy("id").agg(*counts), "id", "left").select("id", gate.alias("a"), rule_gate(F.col("k"), rules, F.col("subjects"), F.col("stream")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got} == {True, False}


def test_tasks_of_a_size(spark):
    """Rows are dealt by key to as many tasks as their number asks for, and the best and the runner-up need no other shuffle."""
    from cutline.operators import windows

    rows = spark.range(9_000).select((F.col("id") % 300).alias("p"), (F.col("id") % 7).alias("s"), F.col("id").alias("v"))
    per = windows.dealt(rows, ["p"], 500).groupBy("p", "s").agg(F.sum("v").alias("v"))
    found = windows.best_and_runner_up(per, ["p"], "s", "v")
    assert found.rdd.getNumPartitions() == 18 and found.count() == 300
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
