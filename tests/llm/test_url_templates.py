"""Templates and verdicts against a plain tree, rules, and odd urls."""

import random
import re

from pyspark.sql import functions as F

from logtable.llm import named
from logtable.llm import url_templates as urls

RULES = named.URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def segments(path):
    path = path.replace("{", "{{")
    pieces = path.split("/", urls.DEPTH)[1:]
    whole_id = re.compile("[0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
    typed = lambda s: "{h}" if whole_id.fullmatch(s) else re.sub("[0-9]+", "{n}", s)
    return ["/".join(typed(s) for s in piece.split("/")) for piece in pieces]


def tree(rows):
    """(host, segments, label) rows -> the template of each, by plain recursion."""
    out = {}

    def profile(members, level):
        counts = {}
        for _, s, label in members:
            after = s[level + 1] if len(s) > level + 1 else None
            then = "end" if after is None else "typed" if "{n}" in after or "{h}" in after else "word"
            counts[label, then] = counts.get((label, then), 0) + 1
        return counts

    def apart(a, b):
        na, nb = sum(a.values()), sum(b.values())
        return sum(abs(a.get(k, 0) / na - b.get(k, 0) / nb) for k in a.keys() | b.keys()) / 2

    def grow(members, level, name):
        live = []
        for row in members:
            if len(row[1]) <= level:
                out[row[0], tuple(row[1])] = name
            else:
                live.append(row)
        groups = {}
        for row in live:
            groups.setdefault(row[1][level], []).append(row)
        known = {s: g for s, g in groups.items() if len(g) >= urls.MIN_URLS and len(g) >= urls.MIN_SHARE * len(members)}
        rest = [row for s, g in groups.items() if s not in known for row in g]
        order = sorted(known.items(), key=lambda kv: (-len(kv[1]), kv[0])) + ([(None, rest)] if rest else [])
        merged = []
        for s, g in order:
            near = next((m for m in merged if apart(profile(m[1], level), profile(g, level)) <= urls.MERGE_DISTANCE), None)
            if near:
                near[0].append(s)
                near[1].extend(g)
            else:
                merged.append(([s], list(g)))
        for names, g in merged:
            words = sorted(n for n in names if n is not None)
            label = "{*}" if None in names else words[0] if len(words) == 1 else "{" + "|".join(words) + "}"
            grow(g, level + 1, f"{name}/{label}")

    for host in {r[0] for r in rows}:
        grow([r for r in rows if r[0] == host], 0, "")
    return out


def judged(rows):
    """The query's (host, path, rule, verdict, template) of (page_id, url) rows."""
    found, learned = [], []
    for page, url in rows:
        host, path = parts(url)
        rule = ruled(host, path)
        label = None if rule is None else rule.verdict
        found.append((page, host, path, rule))
        learned.append((host, segments(path), label))
    names = tree(learned)
    counts = {}
    for host, s, label in learned:
        c = counts.setdefault((host, names[host, tuple(s)]), [0, 0])
        c[0] += label == "block"
        c[1] += label is not None
    blocked, labelled = (sum(c[i] for c in counts.values()) for i in (0, 1))
    base = blocked / labelled if labelled else 0
    out = []
    for (page, host, path, rule), (_, s, _) in zip(found, learned):
        name = names[host, tuple(s)]
        b, n = counts[host, name]
        bad = n > 0 and (b + urls.PRIOR_URLS * base) / (n + urls.PRIOR_URLS) >= urls.REJECT_FROM
        out.append((page, host, path, rule and rule.name, rule.verdict if rule else "block" if bad else "allow", name))
    return sorted(out, key=repr)


def result(spark, rows):
    frame = spark.createDataFrame(rows, "page_id bigint, url string").repartition(3)
    found = urls.judged(frame, RULES).select("page_id", "host", "path", "rule", "verdict", "template")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(n=1500):
    draw = random.Random(11)
    hosts = ["a.example.com"] * 6 + ["B.Example.net", "example.org", "www.example.com", "example.net", "x.org", "c.io"]
    out = []
    for i in range(n):
        lang = draw.choice(["de", "en", "fr", "es", "x" + str(i), "word" + "abc"[i % 3] * draw.randint(1, 30)])
        tail = draw.choice([f"{i}", f"{i}.html", f"{i}/", "about", f"{i:032x}", "p/q/r/s/t/u/v/w", "{odd}/1", ""])
        out.append((i, f"https://{draw.choice(hosts)}/{lang}/{tail}" + draw.choice(["", "?a=/de/", "#x"])))
    return out


ODD = [
    (None, None), (1, ""), (2, "no scheme/de/"), (3, "http://"), (4, "http://net"), (5, "http://NET/"), (6, "http://a.net?x=1"),
    (7, "://ÄX.example.com/de/1"), (8, "http://notexample.com/de/x"), (9, "http://example.com/de"), (10, "http://a://b.net/en/"),
    (11, "ftp://u@example.net:8/en/"), (12, "http://example.net\n/en/q"), (13, "http://h/" + "9/x" * 30_000), (13, "http://h/" + "9/x" * 30_000),
]


def test_verdicts_equal_a_plain_tree(spark):
    rows = made() + ODD
    assert result(spark, rows) == judged(rows)


def test_learned_templates_reject_and_spare(spark):
    spam = [("shop.io", f"/pills/buy{'abcdefgh'[i % 8] * (i % 5 + 1)}x/{i}", 1) for i in range(40)]
    fine = [("shop.io", f"/news/{i}", 0) for i in range(40)] + [("shop.io", f"/news/{i}", None) for i in range(40, 60)]
    unknown = [("shop.io", f"/pills/other/{i}", None) for i in range(3)] + [("new.io", "/pills/x/1", None)]
    frame = spark.createDataFrame(spam + fine + unknown, "host string, path string, label int")
    tree_ = urls.templates(frame).select("path_id", "rejected")
    rows = urls.with_path_id(frame).join(tree_, "path_id").collect()
    assert len(rows) == len(spam + fine + unknown)
    rejected = {(r["host"], r["path"].split("/")[1]): r["rejected"] for r in rows if r["label"] is None}
    assert rejected[("shop.io", "news")] is False and rejected[("new.io", "pills")] is False
    assert all(r["rejected"] for r in rows if r["label"] == 1)


def test_no_labels_no_rows_and_clashing_names(spark):
    assert {r[4] for r in result(spark, [(i, f"http://h.io/{i}") for i in range(9)])} == {"allow"}
    assert result(spark, []) == []
    frame = spark.createDataFrame([(1, "http://a.net/x", "p", "h", 3)], "page_id bigint, url string, path string, Host string, n int")
    row = urls.judged(frame, RULES).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"], row["n"]) == ("a.net", "/x", "net/", "block", 3)


def test_hot_keys_are_joined_apart(spark):
    from logtable.llm.rows import joined_by_key

    rows = spark.createDataFrame([(None if i % 3 else i % 500, i) for i in range(6000)], "k int, i int")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).filter("k is null or k < 400")
    found = joined_by_key(rows, facts, ["k"], "n", 6000).collect()
    top = {r["k"]: r["top"] for r in facts.collect()}
    assert len(found) == 6000 and all(r["top"] == top.get(r["k"]) for r in found)
