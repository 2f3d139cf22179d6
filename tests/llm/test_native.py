"""The operators that use DataFrame functions only, against brute force or DuckDB, on the small tables and on odd rows."""

import hashlib
import re
import unicodedata

import duckdb
import pytest
import xxhash

from edgewise.llm import chat, fingerprints, licenses, queries, urls

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Ünïcode  Straße"), (5, "ünïcode strasse"), (6, "ünïcode strasse\n"), (6, "two of one id"), (6, "two of one id"), (None, "no id"),
    (None, None), (9, "ﬁne ２ 😀" * 400), (10, "Licensed under\nthe MIT License. Released under the MIT License."), (11, "licensed UNDER the apache license version 2.0!"), (12, "x " * 30000),
    (13, "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 2."),
]
EXTRA = ", lang string, hash string, canon string, place int, copy int, license string, units int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "h", "c", 1, 2, "l", 3) for i, t in ODD], "doc_id long, text string" + EXTRA)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def canonical(text):
    # Case folding may leave a form that is not composed; only the order of steps matters here.
    return re.sub(r"[\s\x85\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000\xa0]+", " ", unicodedata.normalize("NFKC", text).casefold()).strip(" ")


def wide(text):
    import struct

    first = xxhash.xxh64_intdigest(text.encode(), 42)
    # A hash of several columns is seeded with that of the column before.
    second = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(fingerprints.SALT.encode(), 42))
    return struct.pack(">QQ", first, second).hex()


def check_fingerprints(got, rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, text) in enumerate(ordered):
        other = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        prints = [wide(canonical(x)) for x in (text, edited, other)]
        want.append((i or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], float(prints[0] == prints[1]), float(prints[0] == prints[2])))
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((r["doc_id"] or 0, *(r[n] for n in names)) for r in got) == sorted(want)


def test_fingerprints(spark, sf_dir, rows, odd, monkeypatch):
    check_fingerprints(queries.op8_fingerprints(spark, sf_dir).collect(), rows)
    check_fingerprints(fingerprints.fingerprints(odd).collect(), ODD)
    assert fingerprints.fingerprints(odd.where("false")).count() == 0
    check_fingerprints(fingerprints.fingerprints(odd.where("doc_id = 9")).collect(), [ODD[10]])
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 7)
    check_fingerprints(queries.op8_fingerprints(spark, sf_dir).collect(), rows)
    check_fingerprints(fingerprints.fingerprints(odd).collect(), ODD)


def test_fingerprints_whose_hashes_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "wide_hash", lambda canon: F.when(F.startswith(canon, F.lit("a")), F.lit("same")).otherwise(canon))
    rows = [(1, "aa"), (2, "A  b"), (3, "a B"), (4, "b"), (5, "ac")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["fingerprint"] == got[3]["fingerprint"] and len({got[k]["fingerprint"] for k in (1, 2, 4, 5)}) == 4


def test_licenses(spark, sf_dir, odd, rows):
    def brute(text):
        units = (text or "").split("\n")
        units.append(text or "")
        hits, n = [], 0
        for unit in units:
            words = re.findall("[a-z0-9]+", unit.lower())
            mine = set(zip(words, words[1:]))
            scores = []
            for name, template in licenses.TEMPLATES.items():
                w = re.findall("[a-z0-9]+", template.lower())
                other = set(zip(w, w[1:]))
                dice = 2.0 * len(mine & other) / (len(mine) + len(other))
                if dice >= licenses.THRESHOLD:
                    scores.append((-dice, name))
            hits += scores
            n += bool(scores)
        best = min(hits, default=(None, None))
        return best[1], best[0] and -best[0], n, len({h[1] for h in hits})

    for got, texts in ((queries.op4_licenses(spark, sf_dir), rows), (licenses.license_scan(odd), ODD)):
        found = sorted((r["doc_id"] or 0, r["license"] or "", r["dice"] or 0, r["n_units"], r["n_licenses"]) for r in got.collect())
        assert found == sorted((i or 0, b[0] or "", b[1] or 0, b[2], b[3]) for i, t in texts for b in [brute(t)])
    assert licenses.license_scan(odd.where("false")).count() == 0
    for template in licenses.TEMPLATES.values():
        bigrams = licenses.template_bigrams(template)
        missed = [b for b in bigrams if not set(b.split()) & set(licenses.telling_words())]
        assert len(missed) < licenses.THRESHOLD / (2 - licenses.THRESHOLD) * len(bigrams)


def test_license_texts_and_windows(spark):
    import textwrap

    texts = {n: textwrap.fill(" ".join(t.split()), 72) for n, t in licenses.TEXTS.items()}
    rows = [(k, "Copyright 2020 Some One\n\n" + texts[n], n) for k, n in enumerate(texts)]
    rows += [(100 + k, "word " * 300 + "\n" + "\n".join("# " + line for line in texts[n].split("\n")) + "\nimport os. " + "other " * 300, n) for k, n in enumerate(("MIT-text", "GPL-3.0-header", "ISC-text", "BSD-3-Clause-text"))]
    notice, wrapped = licenses.TEMPLATES["MIT"], textwrap.fill(licenses.TEMPLATES["BSD-redistribution"], 72)
    rows += [(200, f"Some words before it. {notice} And many more words after the notice.", "MIT"), (201, f"First line of a file\n{wrapped}\nlast line", "BSD-redistribution"), (202, f"Four words or more. {notice}\n" * 50, "MIT")]
    rows += [(300, "Permission to use the licence was granted. The software is free.", None), (301, " ".join(reversed(texts["MIT-text"].split())), None)]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {i: got[i]["license"] for i, *_ in rows} == {i: n for i, _, n in rows}
    assert got[200]["dice"] == got[202]["dice"] == 1.0 and got[200]["n_units"] == 1 and got[300]["n_units"] == 0


def test_chat_against_sql(spark, sf_dir):
    got = queries.op1_chat(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(queries.CHAT_SQL)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "<s>&amp;[x]"), (1, 1, "assistant", "&lt;"), (1, 1, "assistant", "&lt;"), (None, 5, "assis\ntant", "a\nb"), (None, 5, "user", "c"), (3, None, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS tree", "2 AS node", "'x' AS leaf")
    from pyspark.sql import functions as F

    got = chat.format_paths(chat.conversation_tree(frame)).select("tree", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    turns = {r["tree"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in got}
    assert turns == {1: ([("user", ""), ("", "<s>&amp;[x]"), ("assistant", "&lt;"), ("assistant", "&lt;")], "&lt;&lt;"), None: ([("assis\ntant", "a\nb"), ("user", "c")], ""), 3: ([("assistant", "")], "")}
    assert chat.format_paths(chat.conversation_tree(frame.where("false"))).count() == 0


def test_reply_trees(spark):
    # 1 -> 2 -> (3, 4 -> 5), 1 -> 6; 7 answers a missing message; 8 and 9 are on a cycle.
    nodes = [(1, None, 1.0), (2, 1, 1.0), (3, 2, 5.0), (4, 2, 2.0), (5, 4, 2.0), (6, 1, 9.0), (7, 99, 0.5), (8, 9, 1.0), (9, 8, 1.0)]
    frame = spark.createDataFrame([("t", n, p, "user", f"m{n}", s) for n, p, s in nodes], "tree string, node long, parent long, role string, text string, score double")
    paths = {}
    for r in chat.chosen_paths(frame, 4).collect():
        paths.setdefault(r["rank"], []).append((r["position"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {1: [1, 6], 2: [1, 2, 3], 3: [1, 2, 4, 5], 4: [7]}
    assert chat.format_paths(frame).collect()[0]["formatted"] == "<s>user\nm1</s><s>user\nm6</s>"
    chain = spark.createDataFrame([("c", k, k - 1 if k else None, "user", "x", 1.0) for k in range(300)], frame.schema)
    assert [r["node"] for r in chat.chosen_paths(chain).orderBy("position").collect()] == list(range(300))


def brute_pages(pages):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]

    ruled, edges = [], {}
    for page_id, url, html in pages:
        host, path = split(url)
        fits = [(len(h + p), h + p, k) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled.append((page_id, host, path, *(max(fits)[1:] if fits else (None, None))))
        for dst in {"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) for m in re.findall(urls.LINK, html or "")}:
            if host and dst != host:
                edges[host, dst] = edges.get((host, dst), 0) + 1

    def spread(edges, kind):
        seeds = {}
        for *_, host, _, _, verdict in ruled:
            if verdict == kind:
                seeds[host] = seeds.get(host, 0) + 1
        total = sum(seeds.values()) or 1
        seeds = {h: n / total for h, n in seeds.items()}
        out = {}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        score = dict(seeds)
        for _ in range(urls.ROUNDS if edges else 0):
            now = {h: (1 - urls.DAMPING) * w for h, w in seeds.items()}
            for (a, b), n in edges.items():
                if a in score:
                    now[b] = now.get(b, 0) + urls.DAMPING * score[a] * n / out[a]
            change = sum(abs(now.get(h, 0) - score.get(h, 0)) for h in now.keys() | score.keys())
            score = now
            if change < urls.TOLERANCE:
                break
        return score

    trust, distrust = spread(edges, "allow"), spread({(b, a): n for (a, b), n in edges.items()}, "block")
    out = []
    for page_id, host, path, rule, verdict in ruled:
        own = [x[-1] for x in ruled if x[1] == host and x[-1]]
        t, d = (r.get(host, 0) + (own.count(k) / len(own) if own else 0) for r, k in ((trust, "allow"), (distrust, "block")))
        out.append((page_id, host, path, rule, verdict or ("block" if d > urls.RATIO * t and d > urls.LEAST else "allow")))
    return out


def test_urls(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    odd = [
        (1, None, None), (2, "no scheme", "<a href='https://bad.com/'>"), (3, "HTTP://Example.ORG/es/x?y#z", '<a HREF="//far.net/q">x</a>'), (4, "https://example.org", ""), (5, "a://b://c/d", None),
        (6, "https://far.net/a", '<a href="https://bad.com/x"><a href="https://Bad.com/y">'), (7, "https://bad.com/de/", None), (8, "https://good.org/?q", "<a href=https://near.net/>"), (8, "https://good.org/p", "<a href=https://near.net/>"),
        (15, "https://b\u00dccher.net/de/", None), (16, "https://x.net/", "<a href='//b\u00dccher.net'><a href='//B\u00dcccher.NET'><a href='//b\u00dcCHER.net'>"),
        (9, "https://near.net#f", '<a href="https://far.net/">'), (10, "https://sub.example.org/en/12", None), (11, "https://notexample.org/en/1", None), (12, "https://x.com/fr/\nq", None), (13, "https://", None), (14, "https://bad.com/", "<a href='https://far.net'>" * 2000),
    ]
    frame = spark.createDataFrame(odd, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS trust", "5 AS h")
    for got, want in ((queries.op5_urls(spark, sf_dir), pages), (urls.judge_pages(frame), odd)):
        found = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()]
        assert sorted(found, key=str) == sorted(brute_pages(want), key=str)
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge_pages(frame).collect()}
    assert verdicts[14] == "block" and verdicts[9] == "allow"
    assert urls.judge_pages(frame.where("false")).count() == 0


def test_url_scores_are_followed_to_the_tolerance(spark):
    # Distrust goes back along a chain of 30 hosts to one whose page is blocked.
    pages = [(k, f"https://h{k}.net/", f"<a href='https://h{k + 1}.net/'>") for k in range(29)] + [(29, "https://h29.net/", "<a href='https://bad.com/'>"), (30, "https://bad.com/de/", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"}


def test_linked_web(spark):
    """Hosts below allowed ones are allowed, those that lead to blocked ones are blocked, those that do both go by the nearer."""
    pages = [(k, f"https://seed{k}.org/", " ".join(f"<a href='https://a0x{j}.net/'>" for j in range(k, 400, 10))) for k in range(10)]
    pages += [(10 + k, f"https://bad{k}.com/de/", None) for k in range(10)]
    wanted, n = {}, 20
    for layer in range(4):
        for k in range(400):
            below = f"https://a{layer + 1}x{k * 7 % 400}.net/" if layer < 3 else "https://end.net/"
            pages.append((n, f"https://a{layer}x{k}.net/p", f"<a href='{below}'>"))
            wanted[n], n = "allow", n + 1
            above = f"https://b{layer - 1}x{k * 3 % 400}.net/" if layer else f"https://BAD{k % 10}.com/x"
            pages.append((n, f"https://b{layer}x{k}.net/p", f"<a href='{above}'><a href='{above}'>"))
            wanted[n], n = "block", n + 1
    pages += [(n, "https://bad3.com/", "<a href='https://a0x5.net/'>"), (n + 1, "https://seed3.org/", None), (n + 2, "https://alone.net/", None)]
    wanted |= {n: "block", n + 1: "allow", n + 2: "allow"}
    got = {r["page_id"]: r["verdict"] for r in urls.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in wanted} == wanted
