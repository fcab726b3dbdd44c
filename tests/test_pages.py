"""Golden pages."""

from pyspark.sql import functions as F

from leadloom.functions import fixed
from leadloom.operators import knowledge, listing, pages as pg
from leadloom.sources import readers


def page(spark, html, url="http://host.in/p", query="steel pune"):
    return spark.createDataFrame([(1, query, url, html)], "page_id long, query string, url string, html string")


def test_name_tiers(spark):
    html = (
        '<html><head><title>Acme Pumps | Home</title><meta content="Acme Site" property="og:site_name">'
        '<script type="application/ld+json">[{"@type":"Person","name":"X Y"},{"@type":"Organization","name":"Acme Pumps India"}]</script>'
        "</head><body><h1>Welcome Acme</h1><p>© 2020 Acme Industrial Pumps Pvt Ltd</p></body></html>"
    )
    rows = pg.name_candidates(page(spark, html)).orderBy(F.desc("score")).collect()
    assert [(r["name"], r["score"]) for r in rows] == [
        ("Acme Pumps India", 10), ("Acme Site", 9), ("Acme Industrial Pumps", 8), ("Acme Pumps", 6), ("Welcome Acme", 5)]
    assert rows[0]["best_name"] == "Acme Pumps India"


def test_addresses_and_people(spark):
    html = (
        "<body><address>12 Hill Road<br>Pune</address><div class='footer-contact'>Call us</div>"
        "<p>500 Market Street</p><p>500 MARKET street</p><p>nothing</p><li>CEO Ravi Kumar leads</li></body>"
    )
    found = [r["address"] for r in pg.page_addresses(page(spark, html)).orderBy("rank").collect()]
    assert found == ["12 Hill Road Pune", "Call us", "500 Market Street"]
    people = [r["person"] for r in pg.decision_makers(page(spark, html)).collect()]
    assert people == ["Ravi Kumar (CEO Ravi Kumar leads)"]


def test_profile_to_record(spark):
    html = (
        "<html><head><meta name='description' content='Makers of pumps'></head><body>Acme Pumps Private Limited\n"
        "<a href='#x'>a</a><a href='https://www.linkedin.com/c'>l</a><a href='https://acme.in/'>site</a>"
        "<p>mail sales@acme.in or call +91 98765 12345</p></body></html>"
    )
    row = pg.profile_to_record(page(spark, html), "Clutch").first()
    assert row["website"] == "https://acme.in/" and row["email"] == "sales@acme.in"
    assert row["phone"] == "+919876512345" and row["description"] == "Makers of pumps"
    assert row["additional_info"] == "Clutch profile: http://host.in/p"


RESULTS = """<html><body>
<div class="result__body"><h2 class="result__title"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Facme.in%2F">Acme <b>Pumps</b></a></h2>
<a class="result__snippet">Call 98765 12346 or info@acme.in</a></div>
<div class="result__body"><a class="result__a" href="https://duckduckgo.com/ads">ad</a></div>
<div class="result__body"><p>no title</p></div>
<div class="result__body"><h2 class="result__title"><a class="result__a" href="https://www.linkedin.com/company/blue-star">Blue Star | LinkedIn</a></h2></div>
</body></html>"""


def test_result_pages(spark):
    rows = readers.records_from_pages(page(spark, RESULTS), "google").orderBy("ord").collect()
    assert [(r["company_name"], r["website"]) for r in rows] == [
        ("Acme Pumps", "https://acme.in/"), ("Blue Star | LinkedIn", "https://www.linkedin.com/company/blue-star")]
    assert rows[0]["email"] == "info@acme.in" and rows[0]["phone"] == "+9876512346"
    assert rows[0]["additional_info"] == "DDG search result for: steel pune"
    found = readers.records_from_pages(page(spark, RESULTS), "linkedin").collect()
    assert [r["company_name"] for r in found] == ["Blue Star"]
    blocked = page(spark, RESULTS + "Select all squares")
    assert readers.records_from_pages(blocked, "google").count() == 0


def test_bing_and_directories(spark):
    bing = '<ol><li class="b_algo"><h2><a href="https://x.in">X Steel</a></h2><p>Snip</p></li><li class="b_algo"><h2><a href="https://www.bing.com/a">b</a></h2></li></ol>'
    assert [r["company_name"] for r in readers.records_from_pages(page(spark, bing), "discovery").collect()] == ["X Steel"]
    clutch = (
        '<ul><li class="provider"><h3 class="company_name"><a href="/profile/acme">Acme</a></h3>'
        '<a class="website-link__item" href="https://acme.in">w</a><div class="provider__services">ERP</div></li></ul>'
    )
    row = readers.records_from_pages(page(spark, clutch, "https://clutch.co/s?q=1"), "clutch").first()
    assert (row["website"], row["industry"], row["source_url"]) == ("https://acme.in", "ERP", "https://clutch.co/profile/acme")
    cards = (
        '<ul><li class="cntanr"><span class="jcn"><a href="/d/acme">Acme Mills</a></span><span class="cont_fl_addr">MG Road, Pune</span>'
        '<a href="https://acme.in">site</a></li></ul>'
    )
    row = readers.records_from_pages(page(spark, cards), "justdial").first()
    assert (row["company_name"], row["address"], row["website"]) == ("Acme Mills", "MG Road, Pune", "https://acme.in")
    linked = cards.replace('<span class="jcn"><a href="/d/acme">Acme Mills</a></span>', '<a href="/d/acme"><b class="title">Acme Mills</b></a>')
    seeds = listing.card_seeds(page(spark, linked)).orderBy("ord").collect()
    assert [(s["url"], s["source_name"]) for s in seeds] == [
        ("https://www.justdial.com/d/acme", "justdial_listing"), ("https://acme.in", "justdial_website")]


def test_listing_seeds(spark):
    html = (
        '<div class="card"><h3><a href="https://www.indiamart.com/acme-mills/">Acme Mills</a></h3><a href="https://acme-mills.in/">w</a></div>'
        '<div class="card"><h3><a href="https://www.indiamart.com/blue/?x=1">Blue</a></h3></div>'
        '<span class="phone">9876512345</span><span class="loc">Station Road, Pune</span>' + " " * 500
    )
    rows = listing.listing_seeds(page(spark, html)).orderBy("ord").collect()
    assert [(r["url"], r["confidence"], r["inline_phone"]) for r in rows] == [
        ("https://www.indiamart.com/acme-mills/", 0.85, None), ("https://acme-mills.in/", 0.8, None),
        ("https://www.indiamart.com/blue/?x=1", 0.85, "9876512345")]
    made = listing.indiamart_records(listing.listing_seeds(page(spark, html))).orderBy("ord").collect()
    assert made[0]["company_name"] == "Acme Mills" and made[0]["additional_info"] == "IndiaMART | steel pune | confidence=0.85"


def test_site_records_with_visited_page(spark):
    results = (
        '<div class="result"><h2><a href="https://www.tradeindia.com/acme">Acme listing</a></h2><p>Pumps</p></div>')
    visited = spark.createDataFrame([(
        "https://www.tradeindia.com/acme",
        "<title>Acme Pumps - TradeIndia</title><table><tr><td>Nature of Business</td><td>Exporter</td></tr>"
        "<tr><td>Address</td><td>Pune</td></tr></table> sales@acme.in")], "url string, html string")
    row = listing.site_records(page(spark, results), "tradeindia", visited).first()
    assert (row["company_name"], row["industry"], row["address"], row["email"]) == (
        "Acme Pumps", "Exporter", "Pune", "sales@acme.in")


def test_profile_facts(spark):
    html = (
        "<p>Contact Person : Mr. Ravi Kumar, 1 person</p>\n<p>Annual Turnover: Rs. 250 Lakh</p>\n<p>No. of Employees: 51 to 100</p>\n"
        "<p>Nature of Business: Exporter\n</p><p>Address: 12 Hill Road Pune</p><p>GST No: 29ABCDE1234F1Z5</p>"
    )
    row = pg.profile_facts(page(spark, html), "directory1").first()
    assert (row["contact_name"], row["owner_role"], row["turnover"], row["employee_count"]) == (
        "Ravi Kumar", "Proprietor", "₹2.50 Cr", "51-200")
    assert (row["industry_type"], row["additional_info"], row["address"]) == ("Exporter", "GST: 29ABCDE1234F1Z5", "")
    cards = pg.profile_facts(page(spark, "<div class='cp-name'>Asha Rao</div>"), "directory1").first()
    assert (cards["contact_name"], cards["owner_role"]) == ("Asha Rao", "Contact Person")


def test_registry_tables(spark):
    html = "<table><tbody><tr><td>Asha Rao</td><td>1</td><td>MD</td></tr><tr><td>Ab</td><td>2</td></tr></tbody></table>"
    rows = knowledge.table_rows(page(spark, html)).orderBy("row").collect()
    assert [r["cells"] for r in rows] == [["Asha Rao", "1", "MD"], ["Ab", "2"]]
    people = spark.createDataFrame(
        [("a", 2, "Second One", ""), ("a", 1, "First One", "MD"), ("a", 3, "x", "")], "c string, pos int, name string, designation string")
    got = knowledge.registry_directors(people, "c").first()
    assert tuple(got) == ("a", "First One", "MD", "First One; Second One")


def test_json_sources(spark):
    panel = (
        '{"Heading":"Acme","AbstractText":"","Infobox":{"content":[{"label":"Founder(s)","value":"A B"},{"label":"CEO","value":"C D"},'
        '{"label":"Employees","value":"about 1,500"},{"label":"x","value":{"a":1}},{"label":"Seat","value":"Headquarters Pune"}]},'
        '"RelatedTopics":[{"Text":"short"},{"Text":"long enough text about acme"}]}'
    )
    row = knowledge.knowledge_panel(spark.createDataFrame([(1, panel)], "id int, panel string"), "id").first()
    assert (row["contact_name"], row["owner_role"], row["employee_count"]) == ("A B", "Founder", "1000+")
    assert (row["address"], row["description"]) == ("Headquarters Pune", "long enough text about acme")
    answer = (
        '{"status":"OK","results":[{"place_id":"p1","name":"Acme","formatted_address":"Pune","types":["point_of_interest","bank"],"rating":4.5}]}')
    detail = '{"result":{"name":"Acme Bank","website":"https://acme.in","types":["gym_club"],"rating":4,"url":"u"}}'
    answers = spark.createDataFrame([(1, "q", answer)], "ord long, query string, answer string")
    basic = knowledge.places_records(answers).first()
    assert (basic["industry"], basic["description"]) == ("Banking & Finance", "Google Places | Rating: 4.5")
    full = knowledge.places_records(answers, spark.createDataFrame([("p1", detail)], "place_id string, detail string")).first()
    assert (full["company_name"], full["address"], full["industry"]) == ("Acme Bank", "Pune", "Fitness & Wellness")
    assert full["additional_info"] == "Google Maps: u | Query: q | Place ID: p1"


def test_entities(spark):
    text = "Wooden Street led by Lokendra Ranawat opened a new warehouse. Revenue was ₹255 crore+. SAP-ERP implemented. Phone: 9314444747"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = {(r["entity_type"], r["entity"]) for r in pg.entity_long(df, "id", ["text"]).collect()}
    assert {("REVENUE", "₹255 crore"), ("ERP", "SAP"), ("PHONE", "9314444747")} <= got


def test_blocked(spark):
    assert pg.usable_pages(page(spark, "x" * 500)).count() == 1
    assert pg.usable_pages(page(spark, "x" * 499)).count() == 0
    assert pg.usable_pages(page(spark, "x" * 600 + fixed.CAPTCHA_MARKERS[0])).count() == 0


def test_cards_of_a_page_come_from_one_parse(spark):
    for source in ("google", "linkedin", "justdial"):
        plan = readers.records_from_pages(page(spark, RESULTS), source)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan, source


def test_linkedin_profiles_once_per_link_else_general(spark):
    again = '<div class="result__body"><a class="result__url" href="https://www.linkedin.com/company/blue-star">x</a></div>'
    pages = page(spark, RESULTS + again).unionByName(
        page(spark, RESULTS.replace("linkedin.com/company", "example.com/c")).withColumn("page_id", F.lit(2).cast("long")))
    rows = readers.records_from_pages(pages, "linkedin").orderBy("ord").collect()
    assert [(r["company_name"], r["source"]) for r in rows] == [
        ("Blue Star", "linkedin"), ("Acme Pumps", "linkedin_general_search"), ("Blue Star | LinkedIn", "linkedin_general_search")]


def test_empty_pages_and_no_pages(spark):
    for html in ("", None, "<div class='result__body'></div>"):
        made = spark.createDataFrame([(1, "q", "http://h.in", html)], "page_id long, query string, url string, html string")
        for source in ("google", "linkedin", "clutch", "justdial", "google_places"):
            assert readers.records_from_pages(made, source).count() == 0
            assert readers.records_from_pages(made.limit(0), source).count() == 0


def test_sources_of_a_run_read_their_own_pages(spark):
    pages = page(spark, RESULTS).withColumn("source", F.lit("google")).unionByName(
        page(spark, RESULTS).withColumn("source", F.lit("linkedin"))).unionByName(
        page(spark, RESULTS).withColumn("source", F.lit(None).cast("string")))
    rows = readers.records_of_all(pages, list(fixed.PLATFORMS)).orderBy("ord").collect()
    assert [(r["company_name"], r["source"]) for r in rows] == [
        ("Acme Pumps", "google"), ("Blue Star | LinkedIn", "google"), ("Blue Star", "linkedin")]
    assert len({r["ord"] for r in rows}) == 3


def test_results_completed_from_their_pages(spark):
    results = page(spark, RESULTS).withColumn("source", F.lit("google")).unionByName(
        page(spark, RESULTS).withColumn("source", F.lit("maps")))
    html = "<meta name='description' content='Makers of pumps'><address>12 Hill Road Pune</address><p>sales@acme.in</p>"
    visited = spark.createDataFrame(
        [(5, "https://acme.in/", html), (6, "https://acme.in/", "<p>later</p>"), (7, None, html)], "page_id long, url string, html string")
    rows = {(r["source"], r["website"]): r for r in readers.records_of_all(results, ["google", "maps"], visited).collect()}
    assert len(rows) == 4
    first = rows["google", "https://acme.in/"]
    assert (first["email"], first["address"]) == ("info@acme.in", "12 Hill Road Pune")
    assert first["additional_info"] == "DDG search result for: steel pune | Search profile: https://acme.in/"
    assert rows["maps", "https://acme.in/"]["address"] == "12 Hill Road Pune"
    assert rows["maps", "https://acme.in/"]["email"] == "sales@acme.in"
    assert rows["google", "https://www.linkedin.com/company/blue-star"]["additional_info"] == "DDG search result for: steel pune"


def test_a_card_lies_at_any_depth(spark):
    from leadloom.functions import markup
    from leadloom.operators import listing

    deep = "<div>" * 1000 + "<li class='b_algo'><h2 id='x'><a href='https://deep.example/'>Deep <b>Works</b></a></h2><p>Far down</p></li>" + "</div>" * 1000
    nested = "<p>one<div class='s'>" + "<ul><li>" * 400 + "<a href='/x'>link</a>" + "</li></ul>" * 400 + "</div>"
    pages = spark.createDataFrame([(1, "q", "u", deep), (2, "q", "u", nested)], "page_id long, query string, url string, html string")
    cards = listing.listing_rows(pages, listing.RULES["discovery"]).collect()
    assert [(r.page_id, r.name, r.href, r.snippet) for r in cards] == [(1, "Deep Works", "https://deep.example/", "Far down")]
    from pyspark.sql import functions as F

    found = markup.with_elements(pages.filter("page_id = 2")).select(
        F.size(markup.select(F.col("nodes"), "div.s ul li a[href]")).alias("hit"), F.size(markup.select(F.col("nodes"), "p a")).alias("miss"),
        F.transform(markup.select(F.col("nodes"), "div li ul li"), lambda n: n["i"]).alias("inner")).first()
    assert (found.hit, found.miss, len(found.inner)) == (1, 0, 399)


def test_selectors_ask_around_the_elements_they_get(spark):
    from leadloom.functions import markup
    from pyspark.sql import functions as F

    html = "<div class='a'><section class='b'><a class='t' href='1'>x</a><p class='b'><a href='2'>y</a></p></section></div><a href='3'>z</a>"
    nodes = F.col("nodes")
    page = markup.with_elements(spark.createDataFrame([(html,)], "html string"))

    def hrefs(selector, outer=None):
        own = nodes if outer is None else markup.inside(nodes, F.get(markup.select(nodes, outer), 0))
        return page.select(F.transform(markup.select(own, selector, nodes), lambda n: n["href"]).alias("x")).first().x

    assert hrefs("div.a a") == ["1", "2"] and hrefs("a") == ["1", "2", "3"] and hrefs(".a .b a[href]") == ["1", "2"]
    assert hrefs("section p.b a, a[href='3'], a.t") == ["1", "2", "3"] and hrefs("a[href*='3'], p a") == ["2", "3"]
    assert hrefs("div.a a", "section") == ["1", "2"] and hrefs("p a", "section") == ["2"] and hrefs("p p a") == []
