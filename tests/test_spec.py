"""Profiles as a model writes them: what is kept, cut, cleaned, and named as a fault."""

import json

from pyspark.sql import functions as F

from garimpo.functions import spec

LEVELS = {"1": "não", "2": "pouco", "3": "talvez", "4": "sim", "5": "muito"}
AXIS = {"key": "Fit é!", "label": "Fit", "question": "Precisa?", "anchors": LEVELS}
GOOD = {"summary": " Sites para escolas ", "buyer": "Diretor", "problem": "Site velho", "rubric": {"axes": [AXIS]}}


def parsed(spark, *specs):
    rows = [(i, s if isinstance(s, str) or s is None else json.dumps(s)) for i, s in enumerate(specs)]
    out = spec.parse_specs(spark.createDataFrame(rows, "n int, spec string").repartition(2)).orderBy("n").collect()
    return [r["parsed"] for r in out], [[tuple(f) for f in r["faults"]] for r in out]


def test_faults_are_named_by_path(spark):
    rubric = lambda **more: GOOD | {"rubric": {"axes": [AXIS]} | more}
    found, faults = parsed(
        spark, GOOD, None, "no json", [1], GOOD | {"buyer": " ", "problem": 7}, GOOD | {"rubric": {"axes": []}}, GOOD | {"rubric": {}},
        GOOD | {"rubric": {"axes": [AXIS | {"anchors": {k: v for k, v in LEVELS.items() if k != "5"}}]}}, GOOD | {"rubric": {"axes": [{k: v for k, v in AXIS.items() if k != "question"}, AXIS]}},
        GOOD | {"targeting": {"ufs": "SP", "cnaePrefixes": {"a": 1}, "cnaeExclude": None}}, rubric(notes="x", hookGood=3), GOOD | {"probes": [{"terms": "portal"}, 5]},
    )
    assert faults == [
        [], [("spec", "esperava um objeto")], [("spec", "esperava um objeto")], [("spec", "esperava um objeto")], [("buyer", "texto obrigatório"), ("problem", "texto obrigatório")],
        [("rubric.axes", "nenhum eixo válido")], [("rubric.axes", "esperava uma lista")], [("rubric.axes", "nenhum eixo válido")], [("rubric.axes.fit_.question", "texto obrigatório")],
        [("targeting.cnaePrefixes", "esperava uma lista"), ("targeting.ufs", "esperava uma lista")], [("rubric.notes", "esperava uma lista"), ("rubric.hookGood", "esperava uma lista")], [("probe.terms", "esperava uma lista")],
    ]
    assert found[0]["summary"] == "Sites para escolas" and [f is None for f in found] == [False] + [True] * 11


def test_what_can_fall_back_falls_back(spark):
    plain = parsed(spark, GOOD)[0][0].asDict(recursive=True)
    assert plain["targeting"] == {"cnae_prefixes": [], "cnae_exclude": [], "ufs": [], "channels": [], "natureza_prefixes": [], "exclude_mei": False, "matriz_only": True, "min_capital": None, "min_age_years": None, "max_age_years": None, "require_trade_name": False}
    assert [r["value"] for r in plain["rubric"]["recommendations"]] == ["abordar", "descartar"] and plain["rubric"]["site_signals"] == "full" and plain["probes"] == plain["icp_coverage"] == []
    assert plain["rubric"]["axes"] == [{"key": "fit_", "label": "Fit", "question": "Precisa?", "anchors": list(LEVELS.values())}]
    full = GOOD | {
        "targeting": {"cnaePrefixes": ["8599-6/05", "8520", "lixo", "9", "8520", 5], "ufs": ["sp", "rjx"], "channels": ["mobile", "fax", 3], "matrizOnly": False, "excludeMei": "yes", "minCapitalSocial": "1e3", "minAgeYears": None, "maxAgeYears": 900, "naturezaPrefixes": ["20625"]},
        "probes": [{"key": "Portal", "terms": ["portal do aluno", " "], "weight": 99, "meaning": "negative"}, {"key": "portal", "terms": ["x"]}, {"key": "null", "terms": ["x"]}, {"key": "empty", "terms": []}, {"key": "b", "label": "N/A", "terms": [f"t{i}" for i in range(20)], "weight": "x"}],
        "rubric": {"axes": [AXIS | {"key": f"a{i}"} for i in range(9)], "recommendations": [{"value": "hookGood", "label": "x"}, {"value": "Ligar já", "label": "Ligar", "when": "none"}, {"value": "v"}], "siteSignals": "minimal", "notes": ["a", "a", "b" * 900], "hookBad": [str(i) for i in range(9)]},
        "icpCoverage": [{"criterion": "escolas", "mapped": True, "mappedTo": "CNAE 8520"}, {"criterion": "null"}, {"criterion": "funcionários", "mapped": "no", "mappedTo": "-"}],
    }
    p = parsed(spark, full)[0][0].asDict(recursive=True)
    t = p["targeting"]
    assert (t["cnae_prefixes"], t["ufs"], t["channels"], t["matriz_only"], t["exclude_mei"], t["min_capital"], t["min_age_years"], t["max_age_years"], t["natureza_prefixes"]) == (["8599605", "8520"], ["SP", "RJ"], ["mobile"], False, False, 1000.0, 0.0, 200.0, ["2062"])
    assert [(x["key"], x["label"], len(x["terms"]), x["meaning"], x["weight"]) for x in p["probes"]] == [("portal", "portal", 1, "negative", 10.0), ("b", "b", 8, "positive", 1.0)]
    assert [a["key"] for a in p["rubric"]["axes"]] == ["a0", "a1", "a2"] and p["rubric"]["recommendations"] == [{"value": "ligar_j_", "label": "Ligar", "when": ""}]
    assert p["rubric"]["site_signals"] == "minimal" and [len(x) for x in p["rubric"]["notes"]] == [1, 400] and len(p["rubric"]["hook_bad"]) == 4
    assert p["icp_coverage"] == [{"criterion": "escolas", "mapped": True, "mapped_to": "CNAE 8520"}, {"criterion": "funcionários", "mapped": False, "mapped_to": ""}]


def test_limits(spark):
    many = GOOD | {"probes": [{"key": f"p{i}", "terms": ["x"]} for i in range(30)], "rubric": {"axes": [AXIS | {"key": f"a{i}"} for i in range(9)]}}
    p = parsed(spark, many)[0][0]
    assert len(p["probes"]) == 12 and len(p["rubric"]["axes"]) == 3


def test_rows_of_a_key_are_computed_once(spark):
    """inside the filter the rows of all probes were computed again for each probe."""
    made = spec._probes(F.try_parse_json("a"))
    plan = spark.createDataFrame([("a",)], "a string").select(made.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json") == 2  # its type and its items
