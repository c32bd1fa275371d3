import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quillgraph.llm.queries.op9 import RULES, op9_url_filter
from quillgraph.llm.urls import Bayes, Segmenter, host_of, judge, page_text, path_of, path_tokens


def test_viterbi_as_brute_force():
    counts = {"the": 50, "river": 5, "there": 8, "iver": 1, "stone": 6, "r": 1}
    cut = Segmenter(counts)

    def best(name):
        if not name:
            return 0.0, []
        options = []
        for k in range(1, len(name) + 1):
            cost = cut.cost.get(name[:k])
            if cost is None and k == 1:
                cost = cut.unknown + 2.0
            if cost is not None:
                c, rest = best(name[k:])
                options.append((cost + c, [name[:k], *rest]))
        return min(options)

    for name in ("theriver", "thereriver", "stonetheriver", "xriver", "", "zzz"):
        assert "".join(cut.split(name)) == name
        cost = sum(cut.cost.get(w, cut.unknown + 2.0) for w in cut.split(name))
        assert abs(cost - best(name)[0]) < 1e-9
    assert cut.split("theriverstone") == ["the", "river", "stone"]


def test_hosts_paths_and_rules(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://example.com/en/", "https://a.example.com/en", "ftp://x.net/es/1#t", "http://x.net/en/", "http://net/fr/", "http://mynet/fr/", "no scheme", None, "", "a://b://c/d", "http://h?q=/p", "http://é.COM/ü"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(1, urls[1], "x")], "page_id long, url string, verdict string")
    got = sorted(judge(df, RULES).collect(), key=lambda r: r.page_id)
    got = [r for i, r in enumerate(got) if i == 0 or r.page_id != got[i - 1].page_id]
    said = [(r.host, r.path, r.rule) for r in got]
    assert said[:7] == [("www.example.com", "/en/1", "www.example.com/en/"), ("example.com", "/en/", "example.com/en/"), ("a.example.com", "/en", "com/"), ("x.net", "/es/1", "net/es/"), ("x.net", "/en/", None), ("net", "/fr/", "net/fr/"), ("mynet", "/fr/", None)]
    assert said[7:] == [("", "", None)] * 3 + [("b:", "//c/d", None), ("h", "", None), ("é.com", "/ü", "com/")]
    assert [r.verdict for r in got[:4]] == ["allow", "block", "allow", "block"] and all(r.verdict in ("allow", "block") for r in got)


def test_the_model_learns_from_the_rules(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'evil'}shop.{'com' if i % 2 else 'net'}/{'x' if i % 2 else 'es'}/1") for i in range(100)]
    rows += [(1000, "http://evilshop.org/es/1"), (1001, "http://goodshop.org/x/1")]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).where("page_id >= 1000").collect()}
    assert got == {1000: "block", 1001: "allow"}
    assert judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    assert Bayes({}, (0, 0), (0, 0), 0).verdict(["x"]) == "allow"


def test_concatenated_hosts_of_the_table_are_split(spark, tmp_path):
    html = "<html><style>p{}</style><p>Evil casino and good garden, casino for evil and garden for good.<br>&copy; {} &middot; see http://{}/x</p>"
    hosts = [("evilcasino", "net", "es"), ("goodgarden", "com", "es")]
    rows = [(i, f"http://{h}.{t}/{p}/1", html.replace("{}", f"{h}.{t}")) for i, (h, t, p) in enumerate(hosts * 30)]
    rows += [(1000, "http://casinoevil.org/es/1", html.replace("{}", "casinoevil.org")), (1001, "http://gardengood.org/es/1", html.replace("{}", "gardengood.org"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in op9_url_filter(spark, str(tmp_path)).where("page_id >= 1000").collect()}
    assert got == {1000: "block", 1001: "allow"}


def test_the_result_does_not_depend_on_what_is_broadcast(spark):
    hosts = ["evilcasino.net", "goodgarden.com", "casinogarden.org", "evilgarden.org", "goodcasino.org", "rareevil.org", "m.gardengood.org"]
    rows = [(i, f"http://{hosts[i % 7]}/{'es' if i % 3 else 'x'}/{'abcdefghij'[i % 10]}{'klm'[i % 3]}") for i in range(140)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    texts = spark.createDataFrame([("evil casino good garden evil casino",), ("good garden rare",)], "text string")
    whole = sorted(judge(df, RULES, texts=texts).collect())
    assert {r.verdict for r in whole if r.rule is None} == {"allow", "block"}
    for few in ({"words": 1}, {"known": 2}, {"names": 2}, {"words": 0, "known": 0, "names": 0}):
        assert sorted(judge(df, RULES, texts=texts, **few).collect()) == whole, few


def test_host_and_path_are_native(spark):
    df = spark.range(1).select(host_of(F.lit("http://A.b/c")).alias("h"), path_of(F.lit("http://A.b/c")).alias("p"))
    assert tuple(df.first()) == ("a.b", "/c")


def test_verdicts_of_a_whole_table_as_brute_force(spark):
    """The words, the cuts and the naive Bayes of op9, worked out in plain Python over all pages."""
    source = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{source}/pages.parquet")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), page_text(F.col("html")).alias("text")).collect()
    dotted = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://\S*|[^\W]+(?:-[^\W]*)*(?:\.[\w-]+)+")
    letters = re.compile(r"[^\W\d_]{2,}")
    counts = Counter(w for r in rows for said in (r.path, dotted.sub(" ", r.text or "")) for w in letters.findall(said.lower()))
    cutter = Segmenter(dict(counts))

    def labels(host):
        return [p for p in re.split(r"[^0-9a-z\x80-\U0010ffff]+", host) if p not in ("", "www", "m")]

    cuts = {p: cutter.split(p) for r in rows for p in labels(r.host)}
    assert sum(len(c) > 1 for c in cuts.values()) >= 15  # concatenated words are cut
    tokens = {r.page_id: ["h:" + w for p in labels(r.host) for w in cuts[p]] + path_tokens(r.path) for r in rows}
    got = {r.page_id: r for r in op9_url_filter(spark, source).collect()}
    seen = {"allow": Counter(), "block": Counter()}
    for i, r in got.items():
        if r.rule is not None:
            seen[r.verdict].update(tokens[i])
    kinds = len(set(seen["allow"]) | set(seen["block"]))
    totals = {v: seen[v].total() + kinds + 1 for v in seen}
    given = Counter(r.verdict for r in got.values() if r.rule is not None)
    free = 0
    for i, r in got.items():
        if r.rule is None:
            odds = math.log(given["block"] / given["allow"])
            odds += sum(math.log((seen["block"][t] + 1) / totals["block"]) - math.log((seen["allow"][t] + 1) / totals["allow"]) for t in tokens[i])
            if abs(odds) > 1e-6:
                assert (r.verdict == "block") == (odds > 0), (i, r, odds)
                free += 1
    assert free > 0


def test_very_long_urls_and_ties(spark):
    rows = [(1, "http://" + "a" * 20_000 + ".org/" + "b/" * 20_000), (2, "http://x.org/y"), (3, "http://x.com/y"), (4, "http://x.net/es/")]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] == "allow" and got[4] == "block"
    even = [(1, "http://a.com/x"), (2, "http://a.net/es/x"), (3, "http://q.org/")]
    assert {r.page_id: r.verdict for r in judge(spark.createDataFrame(even, "page_id long, url string"), RULES).collect()}[3] == "allow"
