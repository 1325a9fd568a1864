"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from garimpo.functions import names, pages, registry as R, text as tx, web as W


def one(spark, make, **values):
    """Evaluate a column made from named string columns over one row."""
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    got = df.select(make(*[F.col(k) for k in values]).alias("x")).first()[0]
    return got.asDict() if hasattr(got, "asDict") else got


@pytest.mark.parametrize(
    "area, phone, want",
    [("11", "99998888", "+5511999998888"), ("011", "987654321", "+5511987654321"), ("11", "33334444", "+551133334444"), ("20", "33334444", None), ("11", "1234567", None), ("11", "13334444", None), ("", "33334444", None), (None, "33334444", None)],
)
def test_phone(spark, area, phone, want):
    got = one(spark, R.classify_phone, a=area, p=phone)
    assert (got and got["e164"]) == want
    if want:
        assert got["is_mobile"] == (len(want) == 14)


@pytest.mark.parametrize("raw, valid", [("11.222.333/0001-81", True), ("11222333000181", True), ("11222333000182", False), ("00000000000000", False), ("1122233300018", False), (None, False)])
def test_cnpj(spark, raw, valid):
    assert one(spark, R.is_cnpj_valid, c=raw) is valid


def test_cnpjs_in_text(spark):
    assert one(spark, R.cnpjs_in, t="CNPJ 11.222.333/0001-81 e 11222333000181", d="12345678901234") == ["11222333000181"]


@pytest.mark.parametrize("mail, site", [("a@Acme.com.br ", "https://acme.com.br"), ("a@gmail.com", None), ("a@gmial.com", None), ("a@hotmail.fr", None), ("a@x.gov.br", None), ("a@contabilx.com.br", None), ("a@usp.edu.br", None), ("a@b.c", None), ("no at", None), (None, None)])
def test_website_from_email(spark, mail, site):
    assert one(spark, R.website_from_email, m=mail) == site


@pytest.mark.parametrize("raw, want", [("RUA DAS FLORES", "Rua das Flores"), ("BR 101 KM 5", "BR 101 KM 5"), ("RUA XV DE NOVEMBRO", "Rua XV de Novembro"), ("DE (CENTRO)", "De (Centro)"), ("SÃO JOÃO 2ª", "São João 2ª")])
def test_title_case(spark, raw, want):
    assert one(spark, R.title_case, r=raw) == want


def test_address(spark):
    keys = dict(kind="RUA", street="RUA DAS FLORES", number="S / N", complement="SALA 2", district="CENTRO", city="SAO PAULO", state="sp", cep="01001-000")
    got = one(spark, R.derive_address, **keys)
    assert got["linha"] == "Rua das Flores, s/n — Sala 2"
    assert got["completo"] == "Rua das Flores, s/n — Sala 2 - Centro, Sao Paulo - SP, 01001-000"
    assert got["maps"].startswith("https://www.google.com/maps/search/?api=1&query=Rua%20das%20Flores%2C%20s%2Fn")
    assert one(spark, R.derive_address, **dict.fromkeys(keys)) is None
    assert one(spark, R.format_cep, c="123") is None


@pytest.mark.parametrize("raw, want", [("20240131", "2024-01-31"), ("20240230", None), ("00000000", None), ("0", None), ("2024", None)])
def test_dates(spark, raw, want):
    got = one(spark, R.rf_date, d=raw)
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize("raw, want", [("1000,50", 1000.5), ("7", 7.0), ("abc", None), ("", None), ("1,2,3", None), ("-5,5", -5.5)])
def test_decimals(spark, raw, want):
    assert one(spark, R.rf_decimal, d=raw) == want


@pytest.mark.parametrize("a, b", [("São João", "Sao Joao"), ("Ünï ñ", "Uni n"), ("é", "e"), (None, None)])
def test_fold(spark, a, b):
    assert one(spark, tx.fold, a=a) == b


@pytest.mark.parametrize("url, host, apex", [("https://www.Shop.Acme.com.br/x?y", "shop.acme.com.br", "acme.com.br"), ("http://10.0.0.1:80/", "10.0.0.1", "10.0.0.1"), ("https://me.wixsite.com/a", "me.wixsite.com", "me.wixsite.com"), ("https://a.b.example.org", "a.b.example.org", "example.org"), ("nothing", "", ""), (None, "", "")])
def test_hosts(spark, url, host, apex):
    assert one(spark, W.host_of, u=url) == host and one(spark, W.apex_of, u=url) == apex


@pytest.mark.parametrize(
    "url, kind",
    [("https://instagram.com/loja", "social"), ("https://instagram.com/p/abc", "document"), ("https://facebook.com/profile.php?id=3", "social"), ("https://youtube.com/@loja/videos", "social"), ("https://br.linkedin.com/in/ana", "linkedin"), ("https://linkedin.com/company/unavailable", "resume"), ("https://linkedin.com/company/acme/", "linkedin_company"), ("https://x.jusbrasil.com.br/a", "legal"), ("https://prefeitura.sp.gov.br", "document"), ("https://cnpj.biz/1", "aggregator"), ("https://acme.com", "site"), ("", "unknown")],
)
def test_kinds(spark, url, kind):
    assert one(spark, W.classify_hit, u=url) == kind


def test_redirects(spark):
    assert one(spark, W.unwrap_redirect, u="//duckduckgo.com/l/?uddg=https%3A%2F%2Facme.com%2Fa&rut=1") == "https://acme.com/a"
    assert one(spark, W.unwrap_redirect, u="/url?q=https://acme.com/&sa=U") == "https://acme.com/"
    assert one(spark, W.unwrap_redirect, u="javascript:void(0)") is None


HTML = """<html><head><title>Loja &amp; Cia &#233; <b>boa</b></title><meta content='Bons produtos' property="og:description"><meta name="viewport" content="x"><meta name="generator" content="WordPress 6">
<script>var a = "<p>fake@script.com</p>"</script></head><body><!-- c@hidden.com --><a href="mailto:Vendas%40Acme.com.br?subject=x">m</a> fale: joao@gmail.com, img@2x.png suporte@outra.com
<a href="https://wa.me/5511987654321">w</a><a href="tel:(11) 3333-4444">t</a> (21) 98888-7777 <form> © 2019 copyright 2023 <a href="https://instagram.com/acme/">i</a></body></html>"""


def test_page(spark):
    s = {k: one(spark, lambda h, u, k=k: W.page_signals(h, u)[k], h=HTML, u="https://www.acme.com.br/") for k in ("title", "emails", "phones", "platform", "footer_year", "ig_handle", "meta_description", "has_form", "has_viewport", "is_js_shell", "site_phone")}
    assert s["title"] == "Loja & Cia é boa" and s["platform"] == "wordpress" and s["footer_year"] == 2023 and s["ig_handle"] == "acme"
    assert s["emails"] == ["vendas@acme.com.br", "joao@gmail.com", "suporte@outra.com"]
    assert s["phones"] == ["+5511987654321", "+551133334444", "+5521988887777"] and s["site_phone"] == "+5511987654321"
    assert s["meta_description"] == "Bons produtos" and s["has_form"] and s["has_viewport"] and not s["is_js_shell"]


def test_probes(spark):
    probes = {"a": ["pilates"], "b": ["e-commerce"], "c": ["não"]}
    assert one(spark, lambda t: W.run_probes(probes, t), t="Estúdio de PILÁTES, nao e.commerce") == {"a": True, "b": False, "c": True}
    assert one(spark, lambda t: W.run_probes(probes, t), t="  ") == {} and one(spark, lambda t: W.run_probes(probes, t), t=None) == {}


def test_names(spark):
    assert one(spark, names.name_tokens, n="11.222.333 PADARIA DO JOÃO & FILHOS 123") == ["PADARIA", "JOAO", "FILHOS"]
    assert one(spark, names.is_name_match, h="Conheça a Padaria do João e Filhos!", n="PADARIA DO JOAO FILHOS") is True
    assert one(spark, names.is_name_match, h="Padaria Filhos João", n="PADARIA DO JOAO FILHOS") is False
    assert one(spark, names.is_name_match, h="x", n=None) is False
    assert one(spark, names.company_tokens, n="ACME COMERCIO LTDA ME") == ["ACME", "COMERCIO"]
    assert one(spark, names.search_query, l="PADARIA DO JOAO FILHOS", t=None, c="Santos", s="SP") == '"PADARIA DO JOAO FILHOS" Santos SP'
    assert one(spark, names.verify_mirror_link, u="https://acme-comercio.com.br", t=None, l="ACME COMERCIO LTDA", f=None) is True
    assert one(spark, names.verify_mirror_link, u="https://acme.com.br", t=None, l="ACME COMERCIO LTDA", f=None) is False
    assert one(spark, names.terms_from_label, l="8690-9/04 — Atividades de podologia (exceto x); pilates") == ["Atividades de podologia", "pilates"]


def test_profiles(spark):
    got = one(spark, names.parse_profile_title, t="Ana Maria Souza - Podóloga | Clínica X | LinkedIn")
    assert got == {"leading": "Ana Maria Souza", "headline": "Podóloga - Clínica X"}
    assert one(spark, names.title_leads_with_name, t="Ana Maria Souza - Podóloga", n="ANA MARIA SOUZA") is True
    assert one(spark, names.headline_has_substance, h="Estudante") is False and one(spark, names.headline_has_substance, h="Podóloga na Clínica X") is True
    assert one(spark, names.headline_has_substance, h=None) is False
    assert one(spark, names.entity_title_matches, t="Acme Comercio: Sobre | LinkedIn", l="ACME COMERCIO LTDA", f=None) is True


def test_csv(spark):
    line = one(spark, lambda a, b, c: R.csv_line([(a, "string"), (b == "1", "boolean"), (c, "string")]), a='x, "y"', b="1", c=None)
    assert line == '"x, ""y""",sim,'


def test_links_are_resolved(spark):
    base = "https://www.a.com.br/pt/sobre.html?x#y"
    links = {
        "contato.html": "https://www.a.com.br/pt/contato.html", "../x": "https://www.a.com.br/x", "../../../x/./y/": "https://www.a.com.br/x/y/", "/": "https://www.a.com.br/", "?q": "https://www.a.com.br/pt/sobre.html",
        "//B.com/A?b": "https://b.com/A", "HTTP://c.com": "http://c.com/", "mailto:a@b.c": None, "javascript:x()": None, "a/..": "https://www.a.com.br/pt/", ".": "https://www.a.com.br/pt/",
    }
    df = spark.createDataFrame([(h,) for h in links], "h string").select("h", W.resolve_href("h", F.lit(base)).alias("u"))
    assert {r["h"]: r["u"] for r in df.collect()} == links


def test_internal_links_are_judged_by_path(spark):
    html = "".join(f'<a href="{h}">' for h in ["/", "/x?a=1", "/x?a=2", "contato", "https://empresa.com/a.pdf", "https://outra.com/contato", "/ajuda.pdf"])
    one = lambda every: spark.range(1).select(W.internal_links(F.lit(html), F.lit("https://empresa.com/"), 5, every)).first()[0]
    assert one(False) == ["https://empresa.com/contato", "https://empresa.com/ajuda.pdf"]
    assert one(True) == ["https://empresa.com/contato", "https://empresa.com/x"]


def test_plain_titles_agree_with_sql(spark):
    import duckdb

    import __spark_entry__ as E

    raw = ["a &quot;b&quot;", "x&#39;y &amp; z&nbsp;", "<b>q</b>&lt;&amp;gt;", "  no break \t\n", "", "t" * 299, " &quot; ", "p\u000bq"]
    rows = [(i, f"<head><TITLE lang=x>{t}</title>") for i, t in enumerate(raw)] + [(len(raw), None), (len(raw) + 1, "none")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "page_id int, html string").select("page_id", W.plain_title_of("html")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert got == dict(con.execute(E.oracle_sql()["html_title_decode"]).fetchall())
    assert one(spark, W.title_of, h=rows[0][1]) == 'a "b"'


@pytest.mark.parametrize(
    "most, make",
    [  # repeated by substitution they had 34, 5.5, 123 and 142 thousand
        (8_000, lambda: W.emails_of("a", "b")), (4_500, lambda: W.internal_links("a", "b")), (8_000, lambda: pages.json_ld("a")), (12_000, lambda: names.verify_mirror_link(F.col("a"), F.col("b"), F.col("c"), F.col("c"))),
    ],
)
def test_what_is_used_many_times_is_bound(spark, most, make):
    plan = spark.createDataFrame([("a", "b", "c")], "a string, b string, c string").select(make().alias("x"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < most


def test_bound_expressions_give_the_same_rows(spark):
    ranked = lambda x: F.array_join(W.rank_emails(F.split(x, ","), F.lit("www.acme.com.br")), ",")
    assert one(spark, ranked, x="z@other.com,a@gmail.com,b@x.acme.com.br,c@acme.com.br") == "b@x.acme.com.br,c@acme.com.br,a@gmail.com,z@other.com"
    links = lambda h: F.array_join(W.internal_links(h, F.lit("https://a.com/x/y"), 9, every=True), ",")
    assert one(spark, links, h='<a href="z"><a href="../q/./r/.."><a href="z?a"><a href="/doc.pdf"><a href="contato/"><a href="//b.com/c">') == "https://a.com/x/contato/,https://a.com/x/z,https://a.com/q/"
    assert one(spark, lambda t: names.verify_mirror_link(F.lit(None).cast("string"), t, F.lit(None).cast("string"), F.lit("Casa Azul Ltda")), t="Casa Azul Bonita") is True
    assert one(spark, lambda h: pages.json_ld(h)["name"], h='<script type="application/ld+json">[1, {"@type": "x"}]</script>') is None
