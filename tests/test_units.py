"""Hand-written cases: text, people, scores, sinks, streams and plans."""

import datetime

import pytest
from pyspark.sql import functions as F

from signalloom.functions import text as tx
from signalloom.operators import extract, people, ranking, score, twins
from signalloom.sources import sinks


def _one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_canonical_url(spark):
    assert _one(spark, tx.canonical_url, "https://WWW.Example.com:443/A/?utm_source=x&b=2&ref=y&a=1#top", "http://e.com/?gclid=1", "http://e.com/p/?refs=1", "not a url") == [
        "https://example.com/A/?b=2&a=1", "http://e.com", "http://e.com/p/?refs=1", "not a url"]


def test_domain_of(spark):
    assert _one(spark, tx.domain_of, "www.Acme.io/x", "https://a.b.co:8080/", "localhost", "") == ["acme.io", "a.b.co", None, None]


def test_entities(spark):
    assert _one(spark, tx.strip_markup, "<p>a&nbsp;&amp;lt; b&#8217;s &#x20B9;5 &unknown;</p><script>x</script>") == ["a &lt; b's ₹5 &unknown;"]


def test_money(spark):
    assert _one(spark, tx.parse_money, "$12 Mn", "Rs 40 Cr", "₹150 crore", "USD 3.5 million", "$1.2B", "5 lakh rupees", "40 crore", "$5 mango", "nothing", "$90000 bn") == [
        12.0, 4.71, 17.65, 3.5, 1200.0, 0.01, 4.71, None, None, None]


def test_raise_amount_skips_valuations(spark):
    assert _one(spark, tx.raise_amount, "raises Rs 2 Cr at Rs 16.7 Cr valuation", "at Rs 16.7 Cr, raises $3 Mn", "valued at $10 Mn", "$5 Mn valuation") == [
        "Rs 2 Cr", "$3 Mn", None, None]


def test_stage_and_names(spark):
    assert _one(spark, tx.norm_stage, "a pre-series b round", "Series C", "pre seed", "none") == ["Pre-Series B", "Series C", "Pre-Seed", None]
    assert _one(spark, tx.norm_name, "The Acme's Labs Pvt. Ltd.", "acme.ai", "Café India") == ["acme", "acme", "caf"]


def test_ascii_boundaries(spark):
    from signalloom.functions.regex import matches

    assert _one(spark, lambda c: matches(c, r"\bcaf\b"), "caféx", "a caf b", "cafe") == [True, True, False]


def test_explanations(spark):
    cols = ("company_id long, name string, sector string, markets array<string>, sells_intl string, currencies array<string>, ships_abroad boolean, "
            "providers array<string>, platform string, breakdown array<struct<key:string,points:int>>")
    row = lambda i, markets=(), sells=None, cur=(), ships=None, prov=(), plat=None, pay=0: (
        i, f"C{i}", "SaaS", list(markets), sells, list(cur), ships, list(prov), plat, [("paymentStack", pay)])
    scored = spark.createDataFrame([
        row(1, ["US", "Global", "UAE", "UK", "EU"], "yes", ["INR", "USD", "EUR"], True, ["Stripe", "PayU"], "Shopify", 5),
        row(2, ["Global"], "yes", ["INR"], None, [], "Shopify", 5), row(3, [], "likely", [], False, ["Stripe"], "Wix", 0),
        row(4), row(5, ["US"], "yes"), row(6, ["US"], "yes")], cols)
    at = datetime.datetime(2024, 1, 11)
    signals = spark.createDataFrame([
        (1, 1, "funding", datetime.datetime(2024, 1, 1), "Seed", 5.0), (2, 1, "funding", datetime.datetime(2023, 1, 1), "Series A", None),
        (3, 1, "directory", at, None, None), (4, 1, "pain", at, None, None), (5, 1, "launch", at, None, None),
        (6, 1, "export", datetime.datetime(2023, 1, 1), None, None), (7, 2, "funding", None, None, None), (8, 3, "directory", at, None, None),
        (9, 6, "expansion", at, None, None)], "signal_id long, company_id long, type string, occurred_at timestamp, stage string, amount_usd_m double")
    got = {r["company_id"]: r["why"] for r in score.explain_score(scored, signals, F.lit(at)).collect()}
    assert got == {
        1: "C1 raised a Seed round of $5.0M 10d ago and launched into US, UAE, UK and has publicly described payment friction. "
           "Fit: site prices in USD/EUR; ships internationally; collects via Stripe, PayU.",
        2: "C2 raised fresh capital. Fit: already sells abroad; runs on Shopify.",
        3: "C3 is listed in a start-up directory. Fit: SaaS model usually bills foreign customers; runs on Wix.",
        4: "C4 shows cross-border potential.", 5: "C5 shows cross-border potential. Fit: already sells abroad (US).",
        6: "C6 is expanding into US."}


def test_people_patterns(spark):
    docs = spark.createDataFrame([
        (1, "Zed was founded by Asha Rao and Vikram Mehta. Saket Saurav, co-founder and CEO, said so.", "Zed"),
        (2, "Raul Rai, co-founder of Nicobar joined. It was backed by angel investors including Anil Kapoor, founder.", "Zed"),
        (3, "Zed co-founder and CEO Suhas Rajkumar likes it. Atomberg co-founder Manoj Meena disagrees.", "Zed"),
        (4, "said co-founder Divya Nair. Our Team Aditya Oza, CTO, VerdeMobility Products.", "Zed")], "doc_id long, text string, company string")
    got = {(r["doc_id"], r["name"], r["role"]) for r in people.people_mentions(docs).collect()}
    assert got == {(1, "Asha Rao", "Co-founder"), (1, "Vikram Mehta", "Co-founder"), (1, "Saket Saurav", "Co-founder and CEO"),
                   (3, "Suhas Rajkumar", "Co-founder and CEO"), (4, "Divya Nair", "Co-founder")}


def test_people_next_to_their_marks(spark):
    far = "Filler words come here without end. " * 40
    docs = spark.createDataFrame([
        (1, "Backed by angels alongside Asha Rao, founder. Later Zed hired well. Asha Rao, founder, spoke.", "Zed"),  # the second place counts
        (2, "Siraj Naviwala Senior Vice President and Our Team Aditya Oza Former CEO met.", "Zed"),
        (3, "Asha Rao, founder. Asha Rao, founder and CEO, left. Vikram Mehta, CFO.", "Zed"),
        (4, "Asha Rao, CEO of Other Works. Vikram Mehta, CTO, BlueMotors. Divya Nair, CFO of Zed.", "Zed"),
        (5, "“It works.” Asha Rao, CEO, Customer: “Great”. Zed was started in 2020 by serial entrepreneurs Anil Sen & Mira Das", "Zed"),
        (6, far + "Asha Rao, CEO, spoke. " + far, "Zed"), (7, None, "Zed"), (8, "", None), (9, "CEO Asha Rao", None),
        (3, "Mira Das, COO.", "Zed"), (10, "\u0001Asha\u0002 Rao, VP, Mira Das", "Zed")], "doc_id long, text string, company string")
    got = sorted((r["doc_id"], r["position"], r["name"], r["role"]) for r in people.people_mentions(docs).collect())
    assert got == [
        (1, 1, "Asha Rao", "Founder"), (2, 1, "Siraj Naviwala", "Senior Vice President"), (2, 2, "Aditya Oza", "Former CEO"),
        (3, 1, "Asha Rao", "Founder and CEO"), (3, 1, "Mira Das", "COO"), (3, 2, "Vikram Mehta", "CFO"), (4, 1, "Divya Nair", "CFO"),
        (5, 1, "Anil Sen", "Co-founder"), (5, 2, "Mira Das", "Co-founder"), (6, 1, "Asha Rao", "CEO"), (9, 1, "Asha Rao", "CEO"),
        (10, 1, "Mira Das", "VP")]
    said = {(r["doc_id"], r["name"]): r["evidence"] for r in people.people_mentions(docs, guards=()).collect()}
    assert said[(6, "Asha Rao")] == "Asha Rao, CEO, spoke." and said[(1, "Asha Rao")] == "Backed by angels alongside Asha Rao, founder."
    assert (4, "Vikram Mehta") in said
    many = ". ".join(f"{a}{b} Rao, CEO" for a in "ABCD" for b in ("ana", "nil", "sha"))
    text = spark.createDataFrame([(1, many, "Zed")], "doc_id long, text string, company string")
    assert people.people_mentions(text).count() == 8 and people.people_mentions(text, per_doc=None).count() == 12


def test_team_sizes(spark):
    assert _one(spark, lambda c: people.team_size(c)["n"], "a 40-member team", "team of about 1,200 works", "employs over 9 people", "1 employees") == [40, 1200, 9, None]


def test_headlines(spark):
    items = spark.createDataFrame([
        (1, "Exclusive: Edtech startup Quanta raises $3 Mn in Series A led by Blume", ""), (2, "Chiratae leads $10 Mn round in quantum startup Quanfluence", ""),
        (3, "ReFit Global expands to Dubai", ""), (4, "Local shop opens in town", ""), (5, "Show HN: Looma – a loom", "")], "item_id long, title string, summary string")
    rows = {r["item_id"]: r for r in extract.headline_leads(items).collect()}
    assert {k: (v["name"], v["type"]) for k, v in rows.items()} == {1: ("Quanta", "funding"), 2: ("Quanfluence", "funding"), 3: ("ReFit Global", "expansion"), 5: ("Looma", "launch")}
    assert rows[1]["amount_usd_m"] == 3.0 and rows[1]["stage"] == "Series A" and rows[3]["markets"] == ["UAE"]


def test_score_bounds_and_monotone(spark):
    base = dict(company_id=1, name="Acme Global", description="x", sector="SaaS", size="startup", in_region=True, sells_intl="unknown", confidence=0.6)
    c = spark.createDataFrame([tuple(base.values())], "company_id long, name string, description string, sector string, size string, in_region boolean, sells_intl string, confidence double").selectExpr(
        "*", "array('Global') AS markets", "timestamp'2024-01-01' AS first_seen_at", "false AS enriched", "cast(array() as array<string>) AS providers", "cast(array() as array<string>) AS currencies", "false AS ships_abroad", "0 AS locales")
    s = spark.createDataFrame([(1, "funding", "Seed", 2.0), (1, "pain", None, None)], "company_id long, type string, stage string, amount_usd_m double").selectExpr(
        "*", "'Acme Global news' AS title", "'' AS summary", "cast(array() as array<string>) AS tags", "cast(array() as array<string>) AS competitors", "1 AS corroborations", "timestamp'2024-01-10' AS occurred_at")
    as_of = F.lit("2024-01-20").cast("timestamp")
    get = lambda sig: score.score_company(c, sig, as_of).first()
    none, one, two = get(s.limit(0)), get(s.where("type = 'funding'")), get(s)
    assert 0 <= none["score"] < one["score"] < two["score"] <= 100
    # The own name does not count as a keyword: base .1 only.
    assert [p["points"] for p in none["breakdown"] if p["key"] == "international"] == [3]


def test_brief_equals_the_greedy_loop(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.choice("abcdefgh") if i > 10 else rnd.choice("ab"), rnd.randrange(20, 100)) for i in range(60)]
    df = spark.createDataFrame(rows, "company_id long, sector string, score int").selectExpr("*", "'new' AS status", "timestamp'2024-01-02' AS last_event_at")
    got = [r["company_id"] for r in ranking.brief_topk(df, F.lit("2024-01-01").cast("timestamp")).orderBy("position").collect()]
    cands = sorted(rows, key=lambda r: (-r[2], r[0]))
    picks, rest = cands[:20], cands[20:]
    seen = {p[1] for p in picks}
    while len(picks) < 25 and rest:
        i = next((k for k, r in enumerate(rest) if r[1] not in seen), 0)
        r = rest.pop(i)
        seen.add(r[1])
        picks.append(r)
    assert got == [p[0] for p in picks]


def test_undo_of_acknowledgements(spark):
    from signalloom.streaming.jobs import current_checkpoint

    log = lambda *a: spark.createDataFrame([(i, x, i * 10) for i, x in enumerate(a, 1)], "seq long, action string, t long").withColumn("at", F.timestamp_seconds("t"))
    at = lambda *a: current_checkpoint(log(*a)).select(F.unix_seconds("checkpoint")).first()[0]
    assert at("ack") == 10 and at("ack", "ack", "undo") == 10 and at("ack", "undo") == 0 and at("ack", "undo", "ack") == 30


def test_csv_and_json_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"id": "1", "company": "A", "signals": ["x"], "funding": null}]')
    (tmp_path / "in" / "b.json").write_text('{"leads": [{"id": "2", "company": "B", "score": 7}]}')
    got = {(r["id"], r["company"], r["score"]) for r in sinks.import_leads_json(spark, str(tmp_path / "in")).collect()}
    assert got == {("1", "A", None), ("2", "B", 7)}
    sheet = spark.createDataFrame([tuple('say "hi"' if c == "why" else c for c in sinks.CSV_COLUMNS)], ", ".join(f"{c} string" for c in sinks.CSV_COLUMNS))
    sinks.export_leads_csv(sheet, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert '"say ""hi"""' in text and sheet.select(sinks.csv_line()).first()[0] in text


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_version(spark.range(3), root, 1)
    sinks.write_version(spark.range(5), root, 2)
    assert sinks.read_version(spark, root).count() == 5 and sinks.read_version(spark, root, 1).count() == 3


NATIVE = ["score_company", "prefilter", "people_mentions", "target_plan", "merge_company", "voice_report", "site_fingerprint", "lead_view", "fold_feedback"]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_stay_in_the_jvm(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_unreadable_bodies_are_kept(spark):
    """Every body gives items or is in the quarantine with a reason."""
    from signalloom.sources import feeds

    item = "<item><title>T</title><link>https://x.example.com/1</link></item>"
    rows = [
        ("ok", f"<rss><channel>{item}</channel></rss>"), ("none", "<rss><channel></channel></rss>"), ("cut", f"<rss><channel>{item}<item><title>Half"),
        ("atom", "<feed><entry><id>https://x.example.com/2</id><title>A</title></entry></feed>"), ("cut atom", "<feed><entry><id>https://x"),
        ("rdf", f"<rdf:RDF>{item}</rdf:RDF>"), ("cut rdf", "<rdf:RDF><item><title>"), ("page", "<html></html>"), ("blank", ""), ("null", None),
    ]
    bodies = spark.createDataFrame(rows, "source_id string, body string").withColumn("fetched_at", F.current_timestamp())
    items, bad = feeds.land_feeds(bodies)
    assert {r["source_id"] for r in items.collect()} == {"ok", "atom", "rdf"}
    assert {r["source_id"]: r["reason"] for r in bad.collect()} == {
        "cut": "malformed", "cut atom": "malformed", "cut rdf": "malformed", "page": "unknown dialect", "blank": "unknown dialect", "null": "unknown dialect"}
    json = spark.createDataFrame(
        [("ok", '{"hits": [{"title": "a", "objectID": "1"}]}'), ("none", '{"hits": []}'), ("cut", '{"hits": [{"title": "a"'), ("other", '{"x": 1}'), ("null", None)], "source_id string, body string")
    assert {r["source_id"]: r["reason"] for r in feeds.unreadable_json(json, "hits").collect()} == {"cut": "malformed", "other": "another shape", "null": "empty"}
    assert feeds.land_hits_json(json, F.current_timestamp()).count() == 1
    assert {r["source_id"] for r in feeds.unreadable_json(json, "forum").collect()} == {r[0] for r in [("ok",), ("none",), ("cut",), ("other",), ("null",)]}


def test_the_newest_status_survives_a_rebuild(spark):
    from signalloom.functions.packs import Topic, TopicPack
    from signalloom.operators import intel

    items = spark.createDataFrame([(1, "the law", "", "s"), (2, "the law", "", "s")], "id long, title string, summary string, source_id string")
    log = spark.createDataFrame([(1, 5, "done"), (1, 2, "seen"), (1, 9, "shared")], "id long, seq long, status string")
    pack = TopicPack((Topic("law", "rules", 1, "law"),))
    got = intel.rebuild_intel(items, log.repartition(3), "id", topics=pack, region="", noise=["zzzz"], competitors=["Zzzz"])
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "shared", 2: "new"}


def test_page_text_takes_the_article_without_chrome(spark):
    from signalloom.operators import sites

    long = "Real words of the story. " * 30
    rows = [
        (1, f"<html><nav>Menu</nav><article><p>{long}</p><p>End.</p></article><footer>Foot</footer></html>"),
        (2, "<html><head><title>T</title><script>var x</script></head><body><p>Short</p><div>Other</div></body></html>"), (3, None), (4, ""),
    ]
    got = {r["page_id"]: r["t"] for r in spark.createDataFrame(rows, "page_id long, html string").select("page_id", sites.page_text(F.col("html")).alias("t")).collect()}
    assert long.strip() in got[1] and "End." in got[1] and "Menu" not in got[1] and "Foot" not in got[1]
    assert "Short" in got[2] and "Other" in got[2] and "var x" not in got[2] and not got[3] and not got[4]


def test_corroborate_merges_repeats_into_the_stored_event(spark):
    from signalloom.operators import twins

    rows = [
        (1, 7, "funding", "a", "u1", None, None, 0.5, 10, ["x"], ["P"]), (2, 7, "funding", "b", "u2", "Seed", 3.0, 0.9, 20, ["y", "x"], []),
        (3, 7, "funding", "c", "u3", "A", 4.0, 0.1, 30, None, ["Q", "P"]), (4, 8, "launch", "d", "u4", None, None, None, 40, [], []),
        (5, 7, "funding", "e", "u1", "B", 9.0, 1.0, 50, ["z"], ["R"]),
    ]
    signals = spark.createDataFrame(
        rows, "signal_id long, company_id long, type string, title string, url string, stage string, amount_usd_m double, confidence double, occurred_us long, tags array<string>, investors array<string>")
    verdicts = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, True), (4, 4, True), (5, 1, False)], "signal_id long, stored_id long, counted boolean")
    got = {r["stored_id"]: r for r in twins.corroborate(signals.repartition(3), verdicts).collect()}
    one = got[1]
    assert (one["title"], one["corroborations"], one["stage"], one["amount_usd_m"], one["confidence"], one["occurred_us"]) == ("a", 3, "Seed", 3.0, 0.9, 10)
    assert (one["tags"], one["investors"], one["extra_urls"]) == (["x", "y"], ["P", "Q"], ["u2", "u3"])
    assert (got[4]["corroborations"], got[4]["extra_urls"]) == (1, None) and set(got) == {1, 4}


def _ways_to_say(pattern, rnd):
    """A text that comes near to what a pattern looks for."""
    import re

    pick = lambda m: rnd.choice(m.group(1).split("|"))
    s, old = re.sub(r"\\b", rnd.choice(["", "", " "]), pattern).replace("?:", ""), None
    while s != old:
        s, old = re.sub(r"\(([^()]*)\)", pick, s), s
    s = rnd.choice(s.split("|"))
    s = re.sub(r"\[\^?([^\]])[^\]]*\]", r"\1", s).replace("\\s", " ").replace("\\d", "7").replace("\\w", "x").replace("\\", "")
    s = re.sub(r"\.\{[^}]*\}|\.\*", " one ", s)
    return re.sub(r"(.)\?", lambda m: rnd.choice(["", m.group(1)]), s).replace("*", "").replace("+", "")


def test_dispatched_patterns_find_what_the_plain_ones_find(spark):
    import random

    from signalloom.functions import fixed_packs as fp
    from signalloom.functions import fixed_values as fv
    from signalloom.functions.regex import dispatched, phrases, plain_words

    rnd = random.Random(5)
    patterns = [*fp.GATE_RULES.values(), *fp.SECTORS.values(), *fp.MARKETS.values(), *fp.INTEL_NOISE, *[t[3] for t in fp.TOPICS], *fp.COMPETITOR_ACTIONS.values(),
                fp.INTEL_REGION, fp.COMPETITOR_STORY, fp.IMPORT_EXCEPT, fp.LISTED_WORDS, phrases(fv.COMPETITORS), "|".join(f"(?:{p})" for p in fp.SECTORS.values()), r"a?b|(x|y)?z+|(q(r|s){2}t)"]
    texts = ["", "é", "₹ 5", "the usa's US-market", "exported", "qrst", "zz", "bb"]
    for p in patterns:
        for _ in range(6):
            near = _ways_to_say(p, rnd)
            texts += [near, f"Why {near.upper()} now", f"x{near}y {near}s", f"é{near}", near[1:], near[:-1]]
    df = spark.createDataFrame([(x,) for x in texts], "s string").withColumn("s", plain_words(F.col("s")))
    assert all(map(dispatched, patterns))
    pairs = [F.sum((F.col("s").rlike("(?i)" + p) != F.col("s").rlike("(?i)" + dispatched(p))).cast("int")) for p in patterns]
    hits = [F.sum(F.col("s").rlike("(?i)" + p).cast("int")) for p in patterns]
    wrong, found = df.select(*pairs).first(), df.select(*hits).first()
    assert not any(wrong) and sum(n > 0 for n in found) > 0.9 * len(patterns)
    # What is not understood stays as it is.
    assert [dispatched(p) for p in (r"(a)\1", r"(?i)a", r"\p{L}", "[a&&[b]]", "a*", ".x", "[^a]b")] == [None] * 7


def test_packs_of_phrases_and_money_keep_their_words(spark):
    from signalloom.functions.packs import RulePack
    from signalloom.functions.text import parse_money, raise_amount

    df = spark.createDataFrame([(x,) for x in ["GLOBAL reach", "globally", "éUAE", "the uae, Us Market", "", None]], "s string")
    pack = RulePack.of_phrases(["global", "UAE", "US market", "café"])
    assert [r[0] for r in df.select(pack.all(F.col("s"))).collect()] == [["global"], [], ["UAE"], ["UAE", "US market"], [], []]
    assert [r[0] for r in df.select(pack.first(F.col("s"), "none")).collect()] == ["global", "none", "UAE", "UAE", "none", "none"]
    m = spark.createDataFrame([(x,) for x in ["us$ 5 mn", "Rs. 83 crore", "12 lakh rupees", "cars 5", "valued at $9 mn, raised inr 40 crore", "$", "7 million usd", None]], "s string")
    got = [(r[0], r[1]) for r in m.select(parse_money(F.col("s")), raise_amount(F.col("s"))).collect()]
    assert [a for _, a in got] == ["us$ 5 mn", "Rs. 83 crore", None, "rs 5", "inr 40 crore", None, None, None]
    assert [x is not None for x, _ in got] == [True, True, True, False, True, False, True, False] and got[0][0] == 5.0


def test_a_gate_without_hits_decides_alike(spark):
    """Rules are tested where a reason depends on them, and stories are judged where the category asks for it; nulls too."""
    from signalloom.operators import gates, intel

    titles = ["Acme raises $ 5 Mn", "Sensex falls as Acme exports", "Acme launches in Dubai", "RBI eases FEMA export realisation rules in India", "Quiet week in India", "Stripe fees", None]
    rows = [(t, s, src, kind, cat, flag) for t in titles for s in ("An Indian firm.", None) for src in ("inc42", "s", None) for kind in ("rss", "hn", None)
            for cat in ("leads", "intel", "voice", None) for flag in (True, None)]
    items = spark.createDataFrame(rows, "title string, summary string, source_id string, kind string, category string, assume_region boolean")
    judged = lambda **k: intel.classify_intel(items, keep_all=True, **k).withColumn("intel_pass", F.col("verdict").isNotNull())
    whole, lean = gates.prefilter(judged()), gates.prefilter(judged(only=F.col("category") == "intel"), with_hits=False)
    assert whole.drop("hits").columns == lean.columns
    same = [*items.columns, "reason", "passed", "route"]
    read = lambda df: sorted(map(str, df.select(*same, F.when(F.col("route") == "intel", F.col("verdict"))).collect()))
    assert read(whole) == read(lean) and len({r["reason"] for r in lean.select("reason").collect()}) >= 5
    assert lean.where("category <> 'intel' AND verdict IS NOT NULL").isEmpty() and not lean.where("route = 'intel' AND verdict IS NOT NULL").isEmpty()


def test_marks_without_a_name_make_no_mention(spark):
    """A role next to no name is null at once, so that nothing more is read around it; people are found as before."""
    text = "The CEO spoke. Asha Rao, co-founder and CEO, said CFO Vikram Mehta left. The firm hired a president."
    docs = spark.createDataFrame([(1, text, "Acme")], "doc_id long, text string, company string")
    marks = people._marks(docs, 400).select(*[F.transform("marks", f).alias(k) for k, f in (("before", people._name_first), ("behind", people._role_first))]).first()
    assert [m and m["who"] for m in marks["before"]] == [None, "Asha Rao", None, None]
    assert [m and m["who"] for m in marks["behind"]] == [None, None, "Vikram Mehta", None]
    assert [(r["name"], r["role"]) for r in people.people_mentions(docs).collect()] == [("Asha Rao", "Co-founder and CEO"), ("Vikram Mehta", "CFO")]
