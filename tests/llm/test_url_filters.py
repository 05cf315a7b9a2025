import random
import re

from sparkprep.llm import url_filters as u

RULES = (u.Rule("org/", True), u.Rule("example.org/es/", False), u.Rule("example.org/en/1", False), u.Rule("com/de/", False))
SCHEMA = "page_id long, url string, html string, host int, suspect string"


def page(i, url, *links):
    return (i, url, "<p>" + "".join(f'<a href="{x}">x</a>' for x in links), 1, "s")


def test_hosts_paths_and_rules(spark):
    urls = {
        "http://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/17#t": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org/en/27": ("example.org", "/en/27", "org/", "allow"),
        "x://notexample.org?/es/": ("notexample.org", "", None, "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://b.net/#a?b": ("b.net", "/", None, "allow"),
        "http://u.com//de/://x": ("u.com", "//de/://x", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "http://ÉX.org/": ("Éx.org", "/", "org/", "allow"),
    }
    rows = [page(i, x) for i, x in enumerate(urls)] + [(99, None, None, None, None), page(7, "no scheme")]
    out = u.judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        url = dict((p[0], p[1]) for p in rows[:-1])[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls.get(url, ("", "", None, "allow"))


def walk(steps, hosts, seed, rounds=u.ROUNDS, damping=u.DAMPING):
    """PageRank over steps {(from, to): weight} by hand: the rank, and what links brought in the last round."""
    total = {h: sum(n for (a, _), n in steps.items() if a == h) for h in hosts}
    rank = dict(seed)
    for _ in range(rounds):
        got = dict.fromkeys(hosts, 0.0)
        for (a, b), n in steps.items():
            got[b] += n / total[a] * rank[a]
        rank = {h: (1 - damping) * seed[h] + damping * got[h] for h in hosts}
    return rank, got


def plain(seeds, edges):
    """host: (trust_rank, distrust_rank, trust, distrust)."""
    hosts = set(seeds) | {x for e in edges for x in e}
    sides = []
    for k, steps in enumerate((edges, {(b, a): n for (a, b), n in edges.items()})):
        seed = {h: seeds.get(h, (0, 0))[k] for h in hosts}
        rank, got = walk(steps, hosts, seed)
        _, every = walk(steps, hosts, dict.fromkeys(hosts, 1.0))
        part = {h: got[h] / every[h] if every[h] else 0.0 for h in hosts}
        sides.append((rank, {h: (1 - u.DAMPING) * seed[h] + u.DAMPING * part[h] for h in hosts}))
    return {h: (sides[0][0][h], sides[1][0][h], sides[0][1][h], sides[1][1][h]) for h in hosts}


def plain_verdicts(rows, rules):
    """The whole operator by hand, for urls with a scheme and a host."""
    split = {r[0]: re.fullmatch(r"[^:]*://([^/?#]*)([^?#]*).*", r[1]).groups() for r in rows}
    fits = {}
    for key, (host, path) in split.items():
        found = [r for r in rules if (host.lower() == r.text.split("/")[0] or host.lower().endswith("." + r.text.split("/")[0]))
                 and path.startswith("/" + r.text.split("/", 1)[1])]
        fits[key] = max(found, key=lambda r: len(r.text)).allow if found else None
    by_host, edges = {}, {}
    for key, _, html, *_ in rows:
        src = split[key][0].lower()
        by_host.setdefault(src, []).append(fits[key])
        for dst in {x.lower() for x in re.findall('"(?:[a-z]+:)?//([^/"]*)', html)} - {src}:
            edges[src, dst] = edges.get((src, dst), 0) + 1
    seeds = {h: (sum(x is True for x in v) / len(v), sum(x is False for x in v) / len(v)) for h, v in by_host.items()}
    scores = plain(seeds, edges)
    least = (1 - u.DAMPING) * u.LEAST
    bad = {h for h, (_, _, t, d) in scores.items() if d >= least - 1e-12 and d > u.THRESHOLD * (t + d)}
    return {k: "allow" if (fits[k] if fits[k] is not None else split[k][0].lower() not in bad) else "block" for k in split}


def test_verdicts_on_random_graphs(spark):
    rng = random.Random(4)
    for size in (6, 25):
        hosts = [f"h{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(size)]
        rows = []
        for i in range(8 * size):
            links = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'en'])}/" for _ in range(rng.choice([0, 0, 1, 3]))]
            rows.append(page(i, f"http://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'en', 'fr'])}/{i}", *links))
        got = {r["page_id"]: r["verdict"] for r in u.judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
        assert got == plain_verdicts(rows, RULES)
        assert set(got.values()) == {"allow", "block"}


def test_links_carry_trust_and_distrust(spark):
    rows = [page(i, f"http://bad.com/de/{i}") for i in range(4)]
    rows += [page(10 + i, f"http://farm{i}.net/", "http://BAD.com/de/1", "//farm0.net/x", "/rel", "http://good.org/") for i in range(3)]
    rows += [page(20, "http://farm1.net/2", "http://bad.com/x"), page(30, "http://good.org/", "https://fine.net/a?b", "http://fine.net/c")]
    rows += [page(31, "http://fine.net/", "http://good.org/")]
    df = spark.createDataFrame(rows, SCHEMA)
    edges = {(r["src"], r["dst"]): r["n"] for r in u.host_edges(df).collect()}
    want = {}
    for _, url, html, *_ in rows:
        src = re.search("//([^/]*)", url)[1].lower()
        for dst in {x.lower() for x in re.findall('"(?:http:|https:)?//([^/"]*)', html)} - {src}:
            want[src, dst] = want.get((src, dst), 0) + 1
    assert edges == want
    seeds = spark.createDataFrame([("bad.com", 0.0, 1.0), ("good.org", 1.0, 0.0), ("farm0.net", 0.0, 0.0)], "host string, trusted double, blocked double")
    edge_rows = spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, n long")
    want = plain({"bad.com": (0, 1), "good.org": (1, 0), "farm0.net": (0, 0)}, want)
    found = {r["host"]: (r["trust_rank"], r["distrust_rank"], r["trust"], r["distrust"]) for r in u.propagate(seeds, edge_rows).collect()}
    assert set(found) == set(want)
    assert all(abs(x - y) < 1e-9 for h in want for x, y in zip(found[h], want[h]))
    verdict = {r["page_id"]: r["verdict"] for r in u.judge(df, RULES).collect()}
    assert verdict[20] == verdict[12] == "block" and verdict[30] == verdict[31] == "allow"


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], SCHEMA), RULES).count() == 0


def test_an_unrelated_link_changes_no_verdict(spark):
    rows = [page(i, "http://a.com/de/x" if i == 0 else f"http://a.com/{i}") for i in range(10)]
    rows += [page(50 + i, "http://b.com/de/x" if i == 0 else f"http://b.com/{i}") for i in range(30)]
    for more in ([], [page(900, "http://y.net/", "http://z.net/")]):
        verdict = {r["page_id"]: r["verdict"] for r in u.judge(spark.createDataFrame(rows + more, SCHEMA), RULES).collect()}
        assert verdict[5] == "block" and verdict[55] == "allow", more


def test_distrust_does_not_shrink_with_the_number_of_linkers(spark):
    rows = [page(i, f"http://bad.com/de/{i}") for i in range(4)]
    rows += [page(10 + i, f"http://part.com/{'de' if i == 0 else 'x'}/{i}") for i in range(5)]
    rows += [page(100, "http://sole.net/", "http://part.com/"), page(101, "http://portal.net/", "http://bad.com/", *[f"http://fine{i}.net/" for i in range(99)])]
    rows += [page(1000 + i, f"http://farm{i}.net/", "http://bad.com/") for i in range(3000)]
    verdict = {r["page_id"]: r["verdict"] for r in u.judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert all(verdict[1000 + i] == "block" for i in range(3000))
    assert verdict[100] == "block" and verdict[101] == "allow"


def test_links_with_many_blanks_and_long_schemes(spark):
    html = "<a href" + " " * 30 + "=" + " " * 30 + '"' + "x" * 40 + "://Far.net/a\">" + "href = " * 20_000 + "</a>"
    edges = u.host_edges(spark.createDataFrame([(1, "http://a.net/", html, 1, "s"), (2, "http://b.net/", None, 1, "s")], SCHEMA))
    assert [tuple(r) for r in edges.collect()] == [("a.net", "far.net", 1)]
