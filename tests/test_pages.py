"""Search pages, structured data, profiles, robots files, addresses, exports."""

import pytest
from pyspark.sql import functions as F
from test_functions import one

from garimpo.functions import pages as P
from garimpo.plans import flows

DDG = """<div class="result results_links"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Facme.com%2F">Acme <b>Ltda</b></a><a class="result__snippet" href="x">Sobre a &amp; Acme</a></div>
<div class="result"><a class="result__a" href="https://google.com/x">no</a></div><div class="result"><a class="result__a" href="https://acme.com/">again</a></div>
<div class="result"><a class="result__a" href="https://b.com/">B</a><div class="result__snippet">bb</div></div>"""
GOOGLE = """<a href="/url?q=https://acme.com/&sa=U"><h3 class="x">Acme</h3></a><div>Uma descrição</div><a href="https://b.com/"><h3>B</h3></a><p>bbb</p> unusual traffic from your computer"""


def test_search_pages(spark):
    data = [(1, "duckduckgo", DDG), (2, "google", GOOGLE), (3, "duckduckgo", "<p>No results.</p>"), (4, "google", '<form id="captcha-form">'), (5, "google", "<p>?</p>"), (6, "duckduckgo", DDG + "challenge-form"), (7, "google", None), (8, "google", "did not match any documents")]
    got = P.parse_search_pages(spark.createDataFrame(data, "search_id int, provider string, html string")).orderBy("search_id", "position").collect()
    assert [(r["search_id"], r["position"], r["url"], r["title"]) for r in got if r["status"] == "ok"] == [(1, 1, "https://acme.com/", "Acme Ltda"), (1, 2, "https://b.com/", "B"), (2, 1, "https://acme.com/", "Acme"), (2, 2, "https://b.com/", "B")]
    assert got[0]["description"] == "Sobre a & Acme" and got[2]["description"].startswith("Uma descrição")
    assert {r["search_id"]: r["status"] for r in got if r["status"] != "ok"} == {3: "empty", 4: "blocked", 5: "unrecognized", 6: "blocked", 7: "unrecognized", 8: "empty"}


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def test_json_ld(spark):
    html = ld("{not json", '{"@graph": [{"@type": "WebSite", "name": "w"}, {"@type": ["Store"], "name": " Loja  Boa ", "telephone": 11, "address": {"streetAddress": "Rua A", "addressRegion": "SP"}, "sameAs": ["https://x.com/a", "ftp://b"]}]}')
    got = one(spark, P.json_ld, h=html)
    assert (got["type"], got["name"], got["telephone"], got["address"], got["same_as"]) == ("Store", "Loja Boa", "11", "Rua A, SP", ["https://x.com/a"])
    assert one(spark, P.json_ld, h=ld('{"@type": "Thing"}')) is None and one(spark, P.json_ld, h="<p>") is None
    assert one(spark, lambda h, m: P.structured_text(m, P.json_ld(h)), h=ld('{"name": "A", "description": "boa"}'), m="Boa") == "Boa — A"


@pytest.mark.parametrize("html, url, status, want", [("", "https://l.com/checkpoint/x", 200, "checkpoint"), ("", "https://l.com/in/a", 999, "checkpoint"), ("<p>Page not found</p>", "https://l.com/in/a", 200, "gone"), ("<p>Sign in to view</p>", "https://l.com/in/a", 200, "auth"), ("<p>hello</p>", "https://l.com/in/a", 200, None)])
def test_walls(spark, html, url, status, want):
    assert one(spark, lambda h, u: P.wall(h, u, F.lit(status)), h=html, u=url) == want


def test_company_and_person(spark):
    got = one(spark, P.entity_facts, h=ld('{"@type": "Organization", "name": "Acme", "numberOfEmployees": {"minValue": 11, "maxValue": 50}}') + "<p>1.234 seguidores</p>")
    assert got["name"] == "Acme" and tuple(got["employee_range"]) == (11, 50) and got["followers"] == 1234
    assert tuple(one(spark, lambda t: P.employee_range(t), t="mais de 10.000 funcionários").values()) == (10000, None)
    assert one(spark, P.employee_range, t="nada") is None
    assert one(spark, P.profile_facts, h="<title>Ana</title>") == {"name": "Ana", "headline": None, "location": None}


def test_robots(spark):
    text = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nDisallow: /admin # x\nDisallow:\nCrawl-delay: 90\n"
    assert one(spark, P.robots, t=text) == {"disallow": ["/admin"], "crawl_delay_ms": 30000.0}
    assert one(spark, lambda t, p: P.robots_allows(P.robots(t), p), t=text, p="/admin/x") is False
    assert one(spark, lambda t, p: P.robots_allows(P.robots(t), p), t=text, p="/") is True


def test_addresses(spark):
    assert one(spark, P.parse_street, r="Av. São João, 123a") == {"tipo": "AVENIDA", "logradouro": "SAO JOAO", "numero": "123A"}
    got = one(spark, P.parse_place_address, r="R. das Flores, 10 - Centro, Santos - SP, 11010-000, Brazil")
    assert (got["tipo"], got["logradouro"], got["numero"], got["bairro"], got["uf"], got["cep"]) == ("RUA", "DAS FLORES", "10", "CENTRO", "SP", "11010000")
    assert one(spark, P.parse_place_address, r=None) is None


def test_errors_and_answers(spark):
    assert one(spark, P.describe_fetch_error, c="ENOTFOUND", m="x") == "domínio não existe" and one(spark, P.describe_fetch_error, c=None, m="fetch failed") == "site inacessível"
    assert [one(spark, P.rate_limit_kind, e=e) for e in ("quota per day", "HTTP 429", "503", "bad", None)] == ["daily", "transient", "transient", "none", "none"]
    assert one(spark, lambda n: P.backoff_ms(n.cast("int")), n="2") == 60000 and one(spark, lambda n: P.backoff_ms(n.cast("int")), n="99") == 300000
    assert one(spark, lambda a: P.salvage_json(a, "x int"), a='```json\n{"x": 1}\n```') == {"x": 1}
    assert one(spark, lambda a: P.salvage_json(a, "x int"), a='Here: {"x": 2}!') == {"x": 2} and one(spark, lambda a: P.salvage_json(a, "x int"), a="none") is None


def test_csv_export(spark, tmp_path):
    base = spark.createDataFrame([("1", 'A "x"', None, "RUA", "das flores", "1", None, "Centro", "Santos", "SP", "11010000", True)], "cnpj string, razao_social string, nome_fantasia string, tipo_logradouro string, logradouro string, numero string, complemento string, bairro string, municipio string, uf string, cep string, mei boolean")
    contacts = spark.createDataFrame([("1", "+5511", True, "rf", "w"), ("1", "+5522", False, "site", None)], "cnpj string, phone_e164 string, is_mobile boolean, source string, wa_me string")
    made = flows.company_export_rows(base, contacts)
    assert made.columns == flows.COMPANY_HEADER and len(made.columns) == 31
    flows.write_csv(made, str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8").splitlines()
    assert lines[0].startswith("﻿cnpj,razao_social") and lines[1].startswith('1,"A ""x""",,') and ",+5522,nao,site,," in lines[1]
    lead = spark.createDataFrame([(1, "a.com", "unmatched", ["x@a.com", "y@a.com"], "2024")], "project_id int, apex string, verdict string, emails array<string>, found_at string")
    for c in "final_url website_url title out_of_reach_by matched_cnpj match_via matched_cnae status notes read_at discarded_at".split():
        lead = lead.withColumn(c, F.lit(None).cast("string"))
    lead = lead.withColumn("phones", F.array().cast("array<string>"))
    scores = spark.createDataFrame([], "project_id int, apex string, best_fit int, tier string, confidence string, wrong_type boolean, hook string, advice string")
    r = flows.lead_export_rows(lead, scores).first()
    assert r["emails"] == "x@a.com · y@a.com" and r["situacao"] == "sem CNPJ na Receita" and len(r) == 20
