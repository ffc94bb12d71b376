import re
from collections import Counter

from orrery.llm.line_dedup import drop_boilerplate


def page(*lines):
    return "<html><head><title>t</title><script>var p='</p>';</script></head><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def make(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, text string").repartition(3)


def lines(html):
    if html is None:
        return []
    t = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "", html)
    t = re.sub(r"(?i)<(?:/?(?:p|title|head|body|html)\b[^>]*|br[^>]*)>", "\n", re.sub(r"[ \t-\r]+", " ", t))
    return [x.strip(" ") for x in re.sub("<[^>]*>", "", t).split("\n") if x.strip(" ")]


def brute(rows, ratio=0.3, least=5):
    host = lambda u: m[1].lower() if (m := re.match(r"[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "")) else ""
    pages, seen = Counter(host(u) for _, u, _ in rows), Counter()
    for _, u, h in rows:
        seen.update((host(u), x) for x in set(lines(h)))
    gone = {k for k, n in seen.items() if k[0] and pages[k[0]] >= least and n > ratio * pages[k[0]]}
    out = Counter()
    for i, u, h in rows:
        kept = [x for x in lines(h) if (host(u), x) not in gone]
        out[i, host(u), len(lines(h)), len(lines(h)) - len(kept), "\n".join(kept)] += 1
    return out


def test_against_brute_force(spark):
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 12}'}.org/p{i}", page("menu", "menu", f"own {i}", "x " * 50 if i % 4 == 0 else "y", "a<br>b")) for i in range(240)]
    rows += [(500, None, page("menu")), (501, "no host", page("menu", "menu")), (502, "http://hot.org/", None), (503, "HTTP://u:p@HOT.org:80/q", ""), (None, "http://hot.org/n", page("menu", "z")), (1, rows[1][1], rows[1][2])]
    rows += [(504, "http://hot.org/long", page(*[f"line {k}" for k in range(20_000)], "menu"))]
    got = Counter(tuple(r) for r in drop_boilerplate(make(spark, rows)).collect())
    assert got == brute(rows)
    assert any(k[3] for k in got)


def test_empty(spark):
    assert drop_boilerplate(make(spark, [(1, "u", "h")]).filter("false")).collect() == []


def test_small_hosts(spark):
    rows = [(10 * n + i, f"http://h{n}.org/{i}", page("menu", f"own {n} {i}", "both" if i < 2 else "z")) for n in range(1, 5) for i in range(n)]
    got = {r.page_id: r.text for r in drop_boilerplate(make(spark, rows)).collect()}
    assert got == {10: "t\nmenu\nown 1 0\nboth"} | {10 * n + i: f"own {n} {i}" + ("\nz" if n == 3 and i == 2 else "") for n in (2, 3, 4) for i in range(n)}
