"""The walk over sitemaps of many sites at once against a plain queue for each site."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagewake.operators import sitemaps as sm

B = sm.Budgets(requests=14, depth=2, documents=7, occurrences=16)
SITES = "site string, robots string, robots_error string, directives array<string>, root_allowed boolean"
DOCS = "url string, origin string, final_url string, outcome string, sha256 string, root_type string, locations array<struct<raw:string, url:string, origin:string>>, requests int, allowed boolean"


def plain(site, docs, approved, disallowed, b):
    """One site, one document and one location at a time."""
    name, robots, error, directives, home = site
    used = {"r": 1, "d": 0, "u": 0}
    reasons = {k: [] for k in (sm.SAFETY, sm.TRANSIENT, sm.DETERMINISTIC, sm.TRUNCATION)}
    queue, dispositions, pages, ordinal, spent = deque(), [], [], 0, False

    def slot(reason):
        nonlocal spent
        if spent:
            return sm.AFTER_BUDGET
        if used["r"] >= b.requests:
            spent = True
            reasons[sm.TRUNCATION].append(sm.NO_REQUESTS)
            return sm.NO_REQUESTS
        used["r"] += 1
        return reason

    if robots in ("success", "empty"):
        listed = directives or ([] if error else [f"{name}/sitemap.xml"])
        if error:
            reasons[sm.SAFETY].append(error)
        for i, url in enumerate(listed, 1):
            ordinal = i
            full = sm.NO_DOCUMENTS if used["d"] >= b.documents else sm.NO_OCCURRENCES if used["u"] >= b.occurrences else None
            if full:
                reasons[sm.TRUNCATION].append(full)
            else:
                used["d"] += 1
                used["u"] += 1
            if error or full:
                dispositions.append((i, url, slot(full or sm.AFTER_SAFETY)))
            else:
                queue.append((i, url, 0))
    else:
        reasons[robots].append(f"robots_{robots}")
    urls, seen, digests = set(), set(), set()
    while queue and not reasons[sm.SAFETY] and not spent:
        q, url, depth = queue.popleft()
        doc = docs.get(url, (url, name, None, "deterministic", None, None, [], 1, True))
        _, origin, final, outcome, sha, root, locs, requests, allowed = doc
        final = final or url
        gate = sm.BAD_ORIGIN if url in docs and (name, origin) not in approved else None if allowed else sm.DISALLOWED
        if gate:
            told = slot(gate)
            if told == gate:
                reasons[sm.SAFETY].append(gate)
            dispositions.append((q, url, told))
            break
        if url in urls or url in seen:
            dispositions.append((q, url, slot(sm.SAME_URL if url in urls else sm.SAME_FINAL)))
            continue
        if used["r"] + requests > b.requests:
            used["r"] = b.requests
            spent = True
            reasons[sm.TRUNCATION].append(sm.NO_REQUESTS)
            dispositions.append((q, url, sm.NO_REQUESTS))
            break
        used["r"] += requests
        same_final = final in seen
        same_digest = outcome == "success" and sha in digests
        urls.add(url)
        seen |= {url, final}
        if outcome == "success":
            digests.add(sha)
        told = sm.SAME_FINAL if same_final else sm.EMPTY if outcome == "empty" else outcome if outcome != "success" else sm.SAME_DIGEST if same_digest else sm.PARSED if root in (sm.INDEX, sm.URLSET) else root or sm.SYNTAX
        dispositions.append((q, url, told))
        if told in (sm.SAME_FINAL, sm.EMPTY, sm.SAME_DIGEST):
            continue
        if told == sm.TRANSIENT:
            reasons[sm.TRANSIENT].append("transient_failure")
            continue
        if told in (sm.DETERMINISTIC, sm.SYNTAX):
            reasons[sm.DETERMINISTIC].append(sm.SYNTAX if told == sm.SYNTAX else "deterministic_failure")
            continue
        if told != sm.PARSED:
            reasons[sm.SAFETY].append(told)
            break
        for entry, (raw, loc, at) in enumerate(locs, 1):
            over = sm.NO_OCCURRENCES if used["u"] >= b.occurrences else sm.NO_DOCUMENTS if root == sm.INDEX and used["d"] >= b.documents else None
            if over:
                if root == sm.INDEX:
                    ordinal += 1
                    dispositions.append((ordinal, loc or raw, slot(over)))
                if over == sm.NO_DOCUMENTS:
                    used["u"] += 1
                reasons[sm.TRUNCATION].append(over)
                break
            used["u"] += 1
            if root == sm.INDEX:
                used["d"] += 1
                ordinal += 1
            bad = sm.AFTER_SAFETY if reasons[sm.SAFETY] else sm.EMPTY_LOC if raw == "" else sm.MALFORMED_LOC if loc is None else None
            if bad:
                if bad != sm.AFTER_SAFETY:
                    reasons[sm.SAFETY].append(bad)
                if root == sm.INDEX:
                    dispositions.append((ordinal, loc or raw, slot(bad)))
                    if spent:
                        break
                else:
                    pages.append((q, entry, loc or raw, bad))
                continue
            if root == sm.INDEX:
                if depth >= b.depth:
                    reasons[sm.TRUNCATION].append(sm.NO_DEPTH)
                    dispositions.append((ordinal, loc, slot(sm.NO_DEPTH)))
                    if spent:
                        break
                else:
                    queue.append((ordinal, loc, depth + 1))
                continue
            told = sm.CROSS_ORIGIN if at != name else sm.PAGE_DISALLOWED if loc in disallowed else sm.SAME_PAGE if any(p[2] == loc and p[3] == sm.ACCEPTED for p in pages) else sm.ACCEPTED
            pages.append((q, entry, loc, told))
    intended = sm.AFTER_SAFETY if reasons[sm.SAFETY] else sm.AFTER_BUDGET
    while queue:
        q, url, _ = queue.popleft()
        dispositions.append((q, url, slot(intended)))
    count = lambda t: sum(p[3] == t for p in pages)
    accepted, crossed, off = count(sm.ACCEPTED), count(sm.CROSS_ORIGIN), count(sm.PAGE_DISALLOWED)
    clean = not reasons[sm.TRUNCATION] and not reasons[sm.DETERMINISTIC]
    answered = robots in ("success", "empty")
    if not accepted and not crossed and not reasons[sm.SAFETY] and clean and not reasons[sm.TRANSIENT] and answered and not home:
        reasons[sm.SAFETY].append(sm.HOME_DISALLOWED)
    if off and not accepted:
        reasons[sm.SAFETY].append(sm.ALL_DISALLOWED)
    if reasons[sm.SAFETY]:
        priority = 1
    elif accepted:
        priority = 3 if clean and not reasons[sm.TRANSIENT] else 2
    elif reasons[sm.TRANSIENT] and clean:
        priority = 4
    else:
        priority = 5 if answered and clean and not crossed and home else 6
    return dispositions, pages, (priority, used["d"], used["u"], accepted, {r for v in reasons.values() for r in v})


def graph(rnd, k, unsafe):
    """A site with nested indexes that share documents, redirects, equal digests, other origins and failures."""
    site = f"https://s{k}.org"
    n = rnd.randrange(3, 14)
    urls = [f"{site}/m{i}.xml" for i in range(n)]
    docs = {}
    for i, url in enumerate(urls):
        final = rnd.choice([None, None, None, None, urls[rnd.randrange(i, n)]])
        outcome = rnd.choices(["success", "empty", "transient", "deterministic"], [12, 1, 1, 1])[0]
        root = rnd.choices([sm.INDEX, sm.URLSET, sm.SYNTAX], [5, 5, 1])[0]
        pick = (lambda: (lambda u: (u, u, site))(rnd.choice(urls))) if root == sm.INDEX else (lambda: (lambda h, j: (f"{h}/p{j}", f"{h}/p{j}", h))(rnd.choice([site] * 9 + ["https://other.org"]), rnd.randrange(12)))
        locs = [pick() for _ in range(rnd.randrange(6))]
        if unsafe and rnd.random() < 0.15:
            locs.insert(rnd.randrange(len(locs) + 1), rnd.choice([("", None, None), ("::", None, None)]))
            outcome, root = rnd.choice([(outcome, root), ("safety", root), ("success", "unsafe_xml_root")])
        docs[url] = (url, rnd.choices([site, "https://bad.org"], [20, unsafe])[0], final, outcome, rnd.choice([f"x{k}", f"y{k}", f"d{k}-{i}", f"e{k}-{i}", f"f{k}-{i}"]), root, locs, rnd.choice([1, 1, 1, 2]), not (unsafe and rnd.random() < 0.04))
    for url, doc in list(docs.items()):  # a final URL leads no further
        if doc[2]:
            docs[doc[2]] = (*docs[doc[2]][:2], None, *docs[doc[2]][3:])
    for url, doc in list(docs.items()):
        if doc[2] and docs[doc[2]][2]:
            docs[url] = (*doc[:2], None, *doc[3:])
    directives = rnd.choice([[], [urls[0]], [urls[0], urls[0], urls[-1]], urls[:2], rnd.choices(urls, k=10)])
    if not directives:
        docs[f"{site}/sitemap.xml"] = (f"{site}/sitemap.xml", site, None, "success", "root", sm.INDEX, [(u, u, site) for u in rnd.sample(urls, min(n, 4))], 1, True)
    robots = rnd.choices(["success", "empty", "transient", "deterministic"], [20, 2, 1, 1])[0]
    error = "robots_html_response" if unsafe and rnd.random() < 0.08 else None
    return (site, robots, error, directives, rnd.random() < 0.7), docs, {f"{site}/p{j}" for j in rnd.sample(range(12), 3)}


@pytest.mark.parametrize("unsafe", [0, 1])
def test_walks_of_two_hundred_graphs_equal_a_plain_queue(spark, unsafe):
    rnd = random.Random(41 + unsafe)
    graphs = [graph(rnd, k, unsafe) for k in range(200)]
    approved = {(g[0][0], g[0][0]) for g in graphs}
    sites = spark.createDataFrame([g[0] for g in graphs], SITES)
    docs = spark.createDataFrame([d for g in graphs for d in g[1].values()], DOCS)
    off = sorted(set().union(*(g[2] for g in graphs)))
    found = sm.diagnose(sites, docs, spark.createDataFrame(sorted(approved), "site string, origin string"), ~F.col("url").isin(off), B)
    queue, pages, verdicts = {}, {}, {}
    for r in found.queue.collect():
        queue.setdefault(r.site, []).append((r.q, r.url, r.told))
    for r in found.pages.collect():
        pages.setdefault(r.site, []).append((r.q, r.entry, r.url, r.told))
    for r in found.sites.collect():
        verdicts[r.site] = (r.priority, r.documents, r.occurrences, r.accepted, set(r.reasons))
    seen = set()
    for site, own, disallowed in graphs:
        want = plain(site, own, approved, disallowed, B)
        assert sorted(queue.get(site[0], [])) == sorted(want[0]), site
        assert sorted(pages.get(site[0], [])) == sorted(want[1]), site
        assert verdicts[site[0]] == want[2], site
        seen |= {t for *_, t in want[0]} | {t for *_, t in want[1]} | {want[2][0]}
    if unsafe:
        assert {sm.AFTER_SAFETY, sm.EMPTY_LOC, sm.MALFORMED_LOC, sm.BAD_ORIGIN, sm.DISALLOWED, sm.NO_REQUESTS} <= seen
    else:
        assert {sm.PARSED, sm.EMPTY, sm.ACCEPTED, sm.SAME_URL, sm.SAME_FINAL, sm.SAME_DIGEST, sm.SAME_PAGE, sm.NO_DOCUMENTS, sm.NO_OCCURRENCES, sm.NO_DEPTH, sm.NO_REQUESTS, sm.AFTER_BUDGET, sm.CROSS_ORIGIN, sm.PAGE_DISALLOWED, 2, 3, 4, 6} <= seen


def test_no_sites(spark):
    found = sm.diagnose(spark.createDataFrame([], SITES), spark.createDataFrame([], DOCS), spark.createDataFrame([], "site string, origin string"), F.lit(True))
    assert (found.queue.count(), found.pages.count(), found.sites.count()) == (0, 0, 0)


def case(spark, docs, directives=("https://a.org/i.xml",), root_allowed=True, allowed=True, budgets=None):
    sites = spark.createDataFrame([("https://a.org", "success", None, list(directives), root_allowed)], SITES)
    return sm.diagnose(sites, spark.createDataFrame(docs, DOCS), spark.createDataFrame([("https://a.org", "https://a.org")], "site string, origin string"), F.lit(allowed), budgets or sm.Budgets())


def doc(url, root, locs, sha, **more):
    row = {"url": url, "origin": "https://a.org", "final_url": None, "outcome": "success", "sha256": sha, "root_type": root, "locations": [(x, x, "https://a.org") for x in locs], "requests": 1, "allowed": True} | more
    return tuple(row.values())


def test_status_ladder(spark):
    index = doc("https://a.org/i.xml", sm.INDEX, ["https://a.org/u.xml", "https://a.org/u.xml"], "1")
    urls = doc("https://a.org/u.xml", sm.URLSET, ["https://a.org/p"], "2")
    r = case(spark, [index, urls]).sites.first()
    assert (r.status, r.recommendation, r.priority, r.next_action, r.accepted) == ("complete", "sitemap_seeded", 3, "submit_diagnostic_for_operator_review", 1)
    r = case(spark, [index, urls], budgets=sm.Budgets(documents=2)).sites.first()
    assert (r.status, r.priority, r.reasons) == ("partial", 2, ["sitemap_document_budget_exhausted"])
    r = case(spark, [doc("https://a.org/i.xml", None, [], None, outcome="transient")]).sites.first()
    assert (r.status, r.priority, r.next_action) == ("retryable", 4, "retry_diagnosis")
    r = case(spark, [doc("https://a.org/i.xml", sm.URLSET, [], "3")]).sites.first()
    assert (r.status, r.priority, r.recommendation) == ("complete", 5, "bounded_homepage_fallback")
    r = case(spark, [doc("https://a.org/i.xml", sm.URLSET, [], "3")], root_allowed=False).sites.first()
    assert (r.status, r.priority, r.reasons) == ("blocked", 1, ["homepage_fallback_disallowed_by_robots"])
    r = case(spark, [index, urls], allowed=False).sites.first()
    assert (r.status, r.priority, r.reasons) == ("blocked", 1, ["all_canonical_page_candidates_disallowed_by_robots"])
    assert case(spark, []).sites.first().priority == 6
