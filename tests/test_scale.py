"""What large inputs ask for: searches that do not start over, inputs read once, pairs found by keys."""

import time

from pyspark.sql import functions as F

from signalloom.functions import fixed_packs as fp
from signalloom.functions import text as tx
from signalloom.functions.packs import RulePack
from signalloom.operators import people, resolve, sites
from signalloom.plans import load

TABLES = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_searched_from_their_start(spark):
    docs = spark.createDataFrame([(1, "word " * 8000), (2, "é. A team of 12 people. A team of 7.")], "doc_id long, text string")
    began = time.time()
    assert [tuple(r) for r in people.team_size_mentions(docs).collect()] == [(2, 12, "A team of 12 people.")]
    assert time.time() - began < 60


def test_keys_and_stages_do_not_depend_on_the_alphabet(spark):
    rows = spark.createDataFrame([("Acme Labs Pvt Ltd",), ("Café Labs.in",), ("Tatéco's thé",), (None,)], "x string")
    assert [r[0] for r in rows.select(tx.norm_name(F.col("x"))).collect()] == ["acme", "caf", "tatcoth", None]
    rows = spark.createDataFrame([("A pre-series b round",), ("né Series C",), ("éseed",), ("none",)], "x string")
    assert [r[0] for r in rows.select(tx.norm_stage(F.col("x"))).collect()] == ["Pre-Series B", "Series C", "Seed", None]


def test_sites_of_one_domain_are_found_by_keys(spark):
    n = 6000
    pages = spark.range(n).select(
        F.col("id").alias("page_id"), F.lit("a.example.com").alias("domain"), F.concat(F.lit("Firm "), F.md5(F.col("id").cast("string"))).alias("title"),
        F.lit("").alias("description"), F.lit("").alias("text"))
    names = pages.select(F.col("page_id").alias("company_id"), F.col("title").alias("name"), F.lit(0).alias("pos"), "domain")
    began = time.time()
    found = sites.match_site_to_name(names, pages)
    assert found.where("company_id = page_id").count() == n == found.count()
    assert time.time() - began < 60


def test_short_names_second_domains_and_missing_values(spark):
    pages = spark.createDataFrame([
        (3, "x.io", "Ab Co", "", ""), (2, "x.io", "Abacus", "", "t"), (1, "y.io", "Long Name", "", ""), (9, "x.io", None, None, None), (8, None, "Ab", "", "")],
        "page_id long, domain string, title string, description string, text string")
    names = spark.createDataFrame([
        (1, "Ab", 0, "x.io"), (2, "Longnamecorpus", 0, "y.io"), (3, "Long Name", 1, "y.io"), (3, "Long Name", 0, "x.io"), (4, None, 0, "x.io"), (5, "Ltd", 0, "x.io"), (6, "Ab", 0, None)],
        "company_id long, name string, pos int, domain string")
    pairs = names.join(pages, "domain").where(sites.name_matches(F.col("name"), F.col("title"), F.col("description"), F.col("text")))
    plain = pairs.groupBy("company_id").agg(F.min_by("page_id", F.struct("pos", "page_id")).alias("page_id"))
    assert sorted(sites.match_site_to_name(names, pages).collect()) == sorted(plain.collect()) == [(1, 2), (3, 1)]


def test_prints_are_read_once(spark):
    prints = spark.createDataFrame([
        ("a", True, ["Y", "X"], ["USD"]), ("a", None, ["X", "X"], None), ("b", None, None, []), (None, True, ["Z"], ["INR"])],
        "domain string, switcher boolean, providers array<string>, currencies array<string>")
    merged = sites.merge_pricing_page(prints)
    assert _plan(merged).count("LogicalRDD") == 1
    assert sorted(tuple(r) for r in merged.select("domain", "switcher", "pages", "providers", "currencies").collect()) == [
        ("a", True, 2, ["X", "Y"], ["USD"]), ("b", None, 1, [], [])]


def test_inputs_of_reports_are_read_once(spark):
    queries = load().QUERIES
    assert _plan(queries["config_preview"](spark, TABLES)).count("Relation [o_orderkey") == 1
    assert _plan(queries["traction_insights"](spark, TABLES)).count("Relation [l_orderkey") == 1
    assert _plan(queries["plausible_name"](spark, TABLES)).count("regexp_extract(") == 1


def test_tiers_see_distinct_names(spark):
    known = spark.createDataFrame([(7, "acme", "acme.com", ["Acmes"]), (8, "blueboltgear", "bolt.com", ["Bolt"])], "company_id long, norm string, domain string, aliases array<string>")
    rows = [(1, "acme", None), (2, "acmes", None), (3, "zzz", "bolt.com"), (4, "blueboltgeer", None), (5, "none", None), (6, "none", None), (6, "acme", None), (None, "acme", None)]
    found = resolve.match_tiers(spark.createDataFrame(rows, "mention_id long, norm string, domain string"), known).select("mention_id", "tier", "company_id")
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([
        (1, "exact", 7), (2, "alias", 7), (3, "domain", 8), (4, "fuzzy", 8), (5, None, None), (6, "exact", 7), (6, "exact", 7), (None, None, None)], key=str)


def test_packs_over_any_text(spark):
    pack = RulePack.of({"a": r"\bab\b", "e": r"\bé"})
    rows = spark.createDataFrame([("x ab",), ("éab",), ("nab",), (None,)], "x string")
    assert [tuple(r) for r in rows.select(pack.first(F.col("x"), "-"), pack.all(F.col("x")), pack.mask(F.col("x"))).collect()] == [
        ("a", ["a"], 1), ("a", ["a"], 1), ("-", [], 0), ("-", [], 0)]
    assert fp.SECTORS




def test_stories_of_a_busy_week_are_compared_in_bulk(spark):
    """25,000 stories of one category and fortnight with words of a small vocabulary: candidates by word are far more than stories."""
    from signalloom.operators import dedup

    n, day = 25_000, 86_400_000_000
    draw = lambda k: F.pmod(F.xxhash64("ord", F.lit(k)), F.lit(1_000_000)) / 1_000_000
    words = F.array_distinct(F.array(*[F.concat(F.lit("word"), F.floor(F.pow(draw(k), 2) * 12000).cast("string")) for k in range(30)]))
    stories = spark.range(n).select(F.col("id").alias("ord")).select(
        "ord", F.lit("m").alias("category"), F.concat(F.lit("t"), (F.col("ord") % 20).cast("string")).alias("topic"), (F.col("ord") * F.lit(14 * day // n)).alias("ts_us"), words.alias("tokens"))
    began = time.time()
    got = {r["ord"]: r["leader"] for r in dedup.story_leaders(stories).collect()}
    assert time.time() - began < 40
    assert len(got) == n and all(got[leader] == leader <= k for k, leader in got.items())


def test_stories_settle_in_rounds(spark):
    """Neither the size of parts nor the number of pairs that are listed changes a leader."""
    from signalloom.operators.dedup import _one_story
    from signalloom.operators.overlap import dated_leaders

    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("ord", F.lit(k)), F.lit(25)).cast("string"))
    sets = spark.range(150).select(F.col("id").alias("ord")).select(
        F.struct("ord").alias("ord"), F.lit("m").alias("category"), F.lit(None).cast("string").alias("topic"), F.floor(F.col("ord") / 2).alias("ts_us"), F.array_distinct(F.array(*[word(k) for k in range(5)])).alias("tokens"))
    leaders = lambda **x: sorted(dated_leaders(sets, _one_story, 30, **x).collect())
    plain = leaders(part=1000)
    assert plain == leaders(part=9, listed=40, one_task=10) and len({r["leader"] for r in plain}) > 5


def test_marks_pass_over_places_that_begin_none(spark):
    """The scan for roles finds what its alternatives alone find, in less time."""
    bare = f"{fp.FOUNDED_BY}|{people._CHAIN}"
    said = [
        "Assistant Vice President", "senior VP - Sales and Growth", "executive VP, Asia", "Vice President", "Co-founder", "cofounder", "coFounder", "founder", "CEO", "CTO", "COO", "CFO", "CMO", "CPO",
        "CBO", "chief Risk Officer", "Managing Director", "MD", "head of Sales Asia", "VP, Sales", "president", "Chairman", "Founder & CEO - HR", "founded by ", "Co-founded in 2019 by ", "started by ",
        "set up by ", "Established by ", "xCEOx", "Macho chef, posed safe mad hero", ""]
    marked = lambda p: F.regexp_replace("t", p, "<$0>")
    rows = spark.createDataFrame([(f"a {x} b {x}",) for x in said], "t string").select(marked(bare), marked(people._MARK)).collect()
    assert all(a == b for a, b in rows) and sum("<" in a for a, _ in rows) == len(said) - 2
    text = spark.range(0, 3000, 1, 1).select(F.repeat(F.concat(F.lit("The firm makes gears and reports steady sales "), "id"), 60).alias("t")).cache()
    text.count()

    def seconds(p):
        began = time.time()
        text.where(F.col("t").rlike(p)).count()
        return time.time() - began

    seconds(bare), seconds(people._MARK)
    assert seconds(people._MARK) < 0.7 * seconds(bare)


def test_stop_words_are_found_by_their_first_letter(spark):
    from signalloom.functions.regex import one_of

    names = spark.createDataFrame([(w,) for w in [*fp.NOT_A_NAME, "Asha", "Foundery", "C", "Co-", "co"]], "t string")
    assert names.where(F.col("t").rlike(f"^{one_of(fp.NOT_A_NAME)}$")).count() == len(fp.NOT_A_NAME)


def test_stories_are_compared_with_kept_ones(spark, monkeypatch):
    """Blocks give the leaders that all pairs give, and what a block is compared with does not grow with repeats."""
    from signalloom.operators import overlap
    from signalloom.operators.dedup import _one_story

    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("ord", F.lit(k)), F.lit(60)).cast("string"))
    sets = spark.range(400).select(F.col("id").alias("ord")).select(
        "ord", F.element_at(F.array(F.lit("m"), F.lit("x"), F.lit(None)), F.pmod("ord", F.lit(3)).cast("int") + 1).alias("category"), F.concat(F.lit("t"), F.pmod("ord", F.lit(4)).cast("string")).alias("topic"),
        F.when(F.col("ord") % 50 > 0, F.floor(F.col("ord") / 2)).alias("ts_us"), F.array_distinct(F.array(*[word(k) for k in range(6)])).alias("tokens"))
    seen = []
    monkeypatch.setattr(overlap, "unrepeated", lambda *a: seen.append(a) or 1 / 0)
    got = {r["ord"]: r["leader"] for r in overlap.dated_leaders(sets, _one_story, 40, part=4, listed=0).collect()}
    rows, kept, want = sets.orderBy("ord").collect(), [], {}
    for r in rows:
        fits = lambda k: k["category"] == r["category"] and r["ts_us"] - k["ts_us"] < 40 and _one_story(len({*k["tokens"]} & {*r["tokens"]}), min(len(k["tokens"]), len(r["tokens"])), k["topic"] == r["topic"])  # noqa: E731, B023
        alone = r["category"] is None or r["ts_us"] is None
        leader = None if alone else next((k["ord"] for k in kept if fits(k)), None)
        want[r["ord"]] = r["ord"] if leader is None else leader
        if leader is None and not alone:
            kept.append(r)
    assert got == want and not seen and 20 < len(kept) < 250
