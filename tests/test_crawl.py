"""Bounded crawls of many scopes at once against a plain queue for each."""

import random
from collections import deque

from pagewake.operators import crawl as cr

LIMITS = cr.Limits(pages=9, depth=3, files=4)


def plain(scope, captures, links, limits):
    name, seed, origin, prefixes = scope
    inside = lambda u: u.startswith(origin + "/") and any(u[len(origin) :] == p or u[len(origin) :].startswith(p.rstrip("/") + "/") for p in prefixes)
    queue, queued, had, asked = deque([(seed, 0, None)]), {seed}, [], []
    files, file_asked, targets, edges, out, files_out = [], set(), set(), set(), 0, 0
    while queue and len(asked) < limits.pages:
        url, depth, parent = queue.popleft()
        accepted, final = captures.get(url, (False, None))
        page = (final or url) if accepted else None
        told = cr.FAILED if page is None else cr.TRACKED if inside(page) else cr.ENTRY if page == seed and depth == 0 else cr.EXTERNAL
        if told == cr.TRACKED and page in had:
            told = cr.REPEATED
        asked.append((len(asked) + 1, url, depth, page, told))
        if told in (cr.TRACKED, cr.REPEATED) and parent:
            edges.add((parent, page))
        if told not in (cr.TRACKED, cr.ENTRY):
            continue
        if told == cr.TRACKED:
            had.append(page)
        for link, is_file in links.get(url, []):
            if is_file:
                if told == cr.ENTRY:
                    continue
                if not link.startswith(origin + "/"):
                    files_out += 1
                elif link not in file_asked and link not in targets and len(file_asked) < limits.files:
                    file_asked.add(link)
                    ok, final = captures.get(link, (False, None))
                    what = cr.FAILED if not ok else cr.TRACKED if (final or link).startswith(origin + "/") else cr.EXTERNAL
                    if ok:
                        targets.add(final or link)
                    files.append((len(file_asked), link, page, what))
                continue
            if not inside(link):
                out += 1
            elif depth < limits.depth and link not in queued and link not in had:
                queue.append((link, depth + 1, page if told == cr.TRACKED else None))
                queued.add(link)
    count = lambda t: sum(a[4] == t for a in asked)
    totals = (len(asked), count(cr.TRACKED), count(cr.FAILED), count(cr.EXTERNAL) + out, count(cr.REPEATED), sum(f[3] == cr.TRACKED for f in files), sum(f[3] == cr.FAILED for f in files), files_out)
    return asked, files, sorted(edges), totals


def graph(rnd, k):
    origin = f"https://s{k}.org"
    n = rnd.randrange(2, 16)
    page = lambda i: f"{origin}/{rnd.choice('ab') if i < 0 else 'ab'[i % 2]}/p{i}"
    pages = [page(i) for i in range(n)] + [f"{origin}/c/out{i}" for i in range(2)]
    files = [f"{origin}/f{i}.pdf" for i in range(7)]
    captures, links = {}, {}
    for u in pages:
        captures[u] = (rnd.random() < 0.85, rnd.choice([None] * 5 + pages[:n]))
        found = rnd.sample(pages, rnd.randrange(0, min(6, len(pages)))) + rnd.choices(pages, k=1) + ["https://other.org/a/x"] * rnd.randrange(2)
        links[u] = sorted([(x, False) for x in found] + [(x, True) for x in rnd.choices([*files, "https://other.org/g.pdf"], k=rnd.randrange(4))])
    for u in files:
        if rnd.random() < 0.9:
            captures[u] = (rnd.random() < 0.85, rnd.choice([None, None, None, files[-1], "https://other.org/h.pdf"]))
    for u, (ok, final) in list(captures.items()):  # a final URL leads no further
        if final and captures.get(final, (True, None))[1]:
            captures[u] = (ok, None)
    prefixes = rnd.choice([["/"], ["/a", "/b"], ["/a"], ["/b"]])
    return (f"s{k}", pages[0], origin, prefixes), captures, links


def test_crawls_of_two_hundred_graphs_equal_a_plain_queue(spark):
    rnd = random.Random(12)
    graphs = [graph(rnd, k) for k in range(200)]
    found = cr.crawl(
        spark.createDataFrame([g[0] for g in graphs], "scope string, seed string, origin string, prefixes array<string>"),
        spark.createDataFrame([(u, *c) for g in graphs for u, c in g[1].items() if "other.org" not in u], "url string, accepted boolean, final string"),
        spark.createDataFrame([(u, i, x, f) for g in graphs for u, ls in g[2].items() for i, (x, f) in enumerate(ls)], "page string, place int, link string, is_file boolean"),
        LIMITS,
    )
    asked, files, edges, totals = {}, {}, {}, {}
    for r in found.requests.collect():
        asked.setdefault(r.scope, []).append(tuple(r)[1:])
    for r in found.files.collect():
        files.setdefault(r.scope, []).append(tuple(r)[1:])
    for r in found.edges.collect():
        edges.setdefault(r.scope, []).append(tuple(r)[1:])
    for r in found.totals.collect():
        totals[r.scope] = tuple(r)[1:]
    seen = set()
    for scope, captures, links in graphs:
        want = plain(scope, captures, links, LIMITS)
        assert sorted(asked[scope[0]]) == want[0], scope
        assert sorted(files.get(scope[0], [])) == want[1], scope
        assert sorted(edges.get(scope[0], [])) == want[2], scope
        assert totals[scope[0]] == want[3], scope
        seen |= {a[4] for a in want[0]} | {"cut" for _ in range(len(want[0]) == LIMITS.pages)} | {"files cut" for _ in range(len(want[1]) == LIMITS.files)}
    assert seen == {cr.TRACKED, cr.FAILED, cr.EXTERNAL, cr.REPEATED, cr.ENTRY, "cut", "files cut"}


def test_no_scopes(spark):
    none = cr.crawl(spark.createDataFrame([], "scope string, seed string, origin string, prefixes array<string>"), spark.createDataFrame([], "url string, accepted boolean, final string"), spark.createDataFrame([], "page string, place int, link string, is_file boolean"))
    assert (none.requests.count(), none.files.count(), none.edges.count(), none.totals.count()) == (0, 0, 0, 0)
