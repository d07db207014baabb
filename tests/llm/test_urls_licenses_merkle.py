import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from ligandspark.llm import licenses, merkle, queries, urls
from tests.llm.conftest import make


def brute_host_path(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = re.match(r"[^?#]*", url.split("://", 1)[1])
    host = re.match(r"[^/?#]*", url.split("://", 1)[1])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[0][len(host):]


def brute_rule(host, path):
    best = None
    for verdict, pattern in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
                             ("allow", "org/fr/")):
        h, p = pattern.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(pattern) > len(best[1]):
                best = (verdict, pattern)
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net", "https://example.net/",
        "https://example.net?/en/", "ftp://net/", "http://xnet/", "http://a.example.com/de/1", "http://example.com/DE/1",
        "http://b.org/fr/", "http://org/fr/x", "http://b.org/frx", "a://b://c/d", "http://É.net/é?ü", "://net/x",
        "http://" + "a" * 5000 + ".net/" + "b/" * 2000, "http://x.example.net/en", "http://net.example.org/fr/#?"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, None, "s", 1) for i, u in rows],
                                 "page_id long, url string, html string, suffix string, n int")


def test_urls(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[4]), (4, URLS[4])]
    rows += [(100 + i, f"http://h{i % 9}.example.{t}/{lang}/{i}?a=1&b={i}")
             for i in range(60) for t, lang in (("net", "de"), ("net", "en"), ("com", "de"), ("org", "en"))]
    got = urls.filter_urls(pages(spark, rows)).collect()
    want = []
    for i, u in rows:
        host, path = brute_host_path(u)
        want.append((i, host, path, (brute_rule(host, path) or (None, None))[1]))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        rule = brute_rule(r["host"], r["path"])
        assert r["verdict"] == (rule[0] if rule else "block" if r["p_block"] > 0.5 else "allow")


def test_urls_small(spark):
    assert urls.filter_urls(pages(spark, [])).count() == 0
    assert [r["verdict"] for r in urls.filter_urls(pages(spark, [(1, "http://a/b"), (2, None)])).collect()] == ["allow"] * 2
    got = urls.filter_urls(pages(spark, [(1, "http://a.net/b"), (2, "http://c/d")])).collect()
    assert {r["verdict"] for r in got} == {"block"}


def spam_and_plain(rng, n, first):
    """URLs of one last label: spam has digits, many parameters and random paths."""
    letters, out = "abcdefghijklmnopqrstuvwxyz", []
    for i in range(n):
        name = "".join(rng.choice(letters) for _ in range(7))
        if i % 2:
            path = "".join(rng.choice(letters + "0123456789") for _ in range(18))
            out.append((first + i, name, f"{path}?a={rng.randint(0, 999)}&b={rng.randint(0, 999)}&c=1", True))
        else:
            out.append((first + i, name, f"{rng.choice(['news', 'about'])}/{rng.choice(['home', 'team'])}", False))
    return out


def test_url_trees_learn_from_the_form_of_urls(spark):
    """Within one last label, and on hosts that no rule names: digits, entropy and
    parameters decide."""
    rng = random.Random(3)
    rules = (urls.Rule("block", "spam.com/"), urls.Rule("allow", "plain.com/"))
    seen = [(i, f"http://{h}.{'spam' if bad else 'plain'}.com/{p}") for i, h, p, bad in spam_and_plain(rng, 400, 0)]
    new = spam_and_plain(rng, 200, 1000)
    rows = seen + [(i, f"http://www.{h}.com/{p}") for i, h, p, _ in new]
    got = {r["page_id"]: r for r in urls.filter_urls(pages(spark, rows), rules).collect()}
    right = sum((got[i]["verdict"] == "block") == bad for i, _, _, bad in new)
    assert right / len(new) >= 0.95 and all(got[i]["rule"] is None for i, *_ in new)


def test_url_suffix_rate_holds_no_own_label(spark):
    rows = [("a.x", "x", 0, "block"), ("a.x", "x", 0, "block"), ("b.x", "x", 1, "allow"), ("c.x", "x", 2, None),
            ("d.y", "y", 3, "allow")]
    base = spark.createDataFrame(rows, "host string, suffix string, part int, verdict string")
    df, n, bad = urls.with_suffix_statistics(base)
    got = {r["host"]: r[urls.SUFFIX[1]] for r in df.collect()}
    s = urls.SMOOTHING
    assert (n, bad) == (4, 2) and got == {
        "a.x": pytest.approx((0 + s / 2) / (1 + s)), "b.x": pytest.approx((2 + s / 2) / (2 + s)),
        "c.x": pytest.approx((2 + s / 2) / (3 + s)), "d.y": pytest.approx(0.5)}


def test_suffixes_lie_below_the_rules(spark):
    df = spark.createDataFrame([("a.b.example.com",), ("a.org",), ("x.y.net",), ("q.example.net",), ("com",), ("",)], "h string")
    assert [r[0] for r in df.select(urls.suffix_of(F.col("h"))).collect()] == [
        "b.example.com", "a.org", "y.net", "q.example.net", "com", ""]


def test_entropy(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("aabb",), ("abcd",)], "t string")
    assert [r[0] for r in df.select(urls._entropy(df.t)).collect()] == [0.0, 0.0, 1.0, 2.0]


# --------------------------------------------------------------------- licenses

def brute_labels(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES):
    """Labels of the phrases and templates that stand in the text, and the share
    of its words that base matches and longest template matches cover."""
    joined = " " + "".join(w.decode() + " " for w in licenses.words_of(text))
    number = {m.end(): k for k, m in enumerate(re.finditer(" (?=.)", joined))}
    labels, covered = set(), set()
    for i, label in [(m, label) for p, label in phrases for m in re.finditer(
            f"(?<= )(?=({' '.join(w.decode() for w in licenses.words_of(p))}) )", joined)]:
        labels.add(label)
        covered.update(range(number[i.start()], number[i.start()] + i[1].count(" ") + 1))
    for markup, label in templates:
        expression = ""
        for piece in re.split("(<<[^>]*>>)", markup):
            if piece == "<<beginOptional>>":
                expression += "(?:"
            elif piece == "<<endOptional>>":
                expression += ")?"
            elif piece.startswith("<<var"):
                expression += "(?:[^ ]+ ){%s,%s}" % tuple(re.findall("[0-9]+", piece))
            else:
                expression += "".join(re.escape(w.decode()) + " " for w in licenses.words_of(piece))
        if re.search("(?<= )" + expression, joined):
            labels.add(label)
    return labels, covered


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL %s BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_bodies(spark):
    """A body with other names is one long match; with a changed mandatory word
    only its shorter beginning is."""
    holders = "THE AUTHORS OR COPYRIGHT HOLDERS"
    texts = [MIT_BODY % holders, MIT_BODY % "ACME INC", (MIT_BODY % holders).replace("sublicense", "sell"),
             "before " + (MIT_BODY % "X").replace("(the", "(hereafter")]
    n = [len(licenses.words_of(t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: max((m["words"] for m in r["matches"]), default=0) for r in licenses.scan_licenses(df).collect()}
    assert (got[0], got[1], got[3]) == (n[0], n[1], 0) and 0 < got[2] < n[2] // 4
    for t in texts:
        assert brute_labels(t)[0] == {m[1] for m in licenses.scan(
            t, [(b" ".join(licenses.words_of(p)), x) for p, x in licenses.PHRASES],
            [licenses.compile_template(m, x) for m, x in licenses.TEMPLATES])[1]}


def test_templates():
    a = licenses.compile_template("one <<beginOptional>>two <<beginOptional>>deep <<endOptional>><<endOptional>>"
                                  "three four <<var;words=0-2>> five", "x")
    say = lambda t: a.longest(licenses.words_of(t), 0)
    assert say("one three four five") == 4 and say("One two, three four; five") == 5
    assert say("one two deep three four a b five x") == 8 and say("one deep three four five") == 0
    assert say("one three four a b c five") == 0 and say("one three for five") == 0
    assert a.anchor == b"three four"
    for bad in ("a <<endOptional>>", "<<beginOptional>>a", "<<var;words=1-2>>"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad, "x")


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                       "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(k, label) for phrase, label in licenses.PHRASES for p in [phrase.split()]
            for k in range(len(words)) if words[k:k + len(p)] == p]
    return len(words), hits


def test_scan(spark, odd_rows, no_docs, monkeypatch):
    rows = odd_rows + [
        (300, "Released under the MIT License. Under the mit license!"), (301, "CC BY-NC cc by nc cc-by-nc 4.0"),
        (302, "Licensed under the Apache License, Version 2.0."), (303, "Apache License Version 20"),
        (304, "This work is licensed under the GNU General Public License, version 3."),
        (305, "licensed under the GNU General Public License, published elsewhere, version 3"),
        (306, "Copyright (c) 2020 Some One. All rights reserved."), (307, "x" + " under the mit license" * 500),
        (308, "under the mit licenseé"), (309, "ünder the mit license"), (310, "under\u00a0the mit license")]
    monkeypatch.setattr(queries, "table", lambda *_: make(spark, rows))
    got = sorted(queries.op5_license_scans(spark, "").collect(), key=lambda r: str((r["doc_id"], r["n_words"], r["n_base"])))
    rows = sorted(rows, key=lambda r: str((r[0], *[f(brute_base(r[1])) for f in (lambda b: b[0], lambda b: len(b[1]))])))
    for r, (i, t) in zip(got, rows, strict=True):
        n, hits = brute_base(t)
        assert (r["doc_id"], r["n_words"], r["n_base"]) == (i, n, len(hits))
        at = [k for k, _ in hits]
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[304] == "gpl-3" and labels[305] == "" and labels[306] == "all-rights-reserved"
    assert labels[302] == "apache-2" and labels[303] == ""
    assert licenses.scan_licenses(no_docs).count() == 0


# ----------------------------------------------------------------------- merkle

def test_next_and_edit(spark, odd_docs, odd_rows, no_docs):
    assert merkle.document_fingerprints(no_docs).count() == 0
    rows = [(i, t) for i, t in odd_rows if i not in (6, 12, None)]
    order = sorted(rows, reverse=True)
    got = {r["doc_id"]: r for r in merkle.document_fingerprints(make(spark, rows).repartition(5)).collect()}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        assert got[i]["text"] == t and got[i]["edited_text"] == t[:len(t) - third] + following[:third]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert merkle.document_fingerprints(odd_docs).count() == len(odd_rows)
    by_text = {}
    for r in merkle.document_fingerprints(odd_docs).collect():
        by_text.setdefault(r["text"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    one = merkle.document_fingerprints(make(spark, [(1, "abc def")])).collect()[0]
    assert one["edited_text"] == "abc deabc"[:5] + "ab" and one["near_next"] == 1.0


def brute_leaves(text, pieces):
    """The sentences of ``text``, cut after each word whose hash is 0 modulo 8 if
    ``pieces``, unless a line, a sentence or the text ends there anyway."""
    if not pieces:
        return re.split(r"(?<=\n)|(?<=[.!?] )", text)
    letter, other = r"[A-Za-z\u00AA-\u0DFF]", r"[^A-Za-z\u00AA-\U0010FFFF\n]"
    words = re.findall(f"{letter}{{1,64}}{other}{{0,8}}|{other}{{1,8}}|[\\s\\S]", text.replace("\x01", "\x01\x02"))
    marked = ""
    for i, w in enumerate(words):
        marked += w
        ends = xxhash.xxh64(w.encode(), seed=42).intdigest() % 8 == 0 and not w.endswith(("\n", ". ", "! ", "? ", "\x01"))
        if ends and "".join(words[i + 1:i + 2])[:1] not in ("", "\n"):
            marked += "\x01\x03"
    out, start, i = [], 0, 0
    while i <= len(marked):                     # where a sentence ends there as well, a mark stays in the next leaf
        if re.search(r"(\n|[.!?] )\Z", marked[max(0, i - 2):i]):
            out.append(marked[start:i])
            start, i = i, i + 1
        elif marked.startswith("\x01\x03", i):
            out.append(marked[start:i])
            start = i = i + 2
        else:
            i += 1
    return [*out, marked[start:]]


def brute_fingerprint(text, pieces=False):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = brute_leaves(text, pieces)
    marked = "".join(sha(s) + (";" if s.endswith("\n") else ",") for s in leaves)
    paragraphs = [sha(p) for p in marked.split(";")]
    sections, own = [], []
    for p in paragraphs:
        own.append(p)
        if p[-1] in "01":
            sections.append(" ".join(own))
            own = []
    if own:
        sections.append(" ".join(own))
    sections = [sha(s) for s in sections]
    return ":".join((sha("".join(sections)), "".join(s[:8] for s in sections), "".join(sha(s)[:8] for s in leaves)))


def test_fingerprint_is_the_tree(spark, odd_rows):
    texts = [t or "" for _, t in odd_rows] + ["a. b! c\n\nd? e", "\n", "cut \x01 here\x01", "a........ b" * 30, "one line.\n" * 40, "x.\ny.\n" + "z " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pieces in (False, True):
        for r in merkle.add_fingerprint(df, "t", "f", pieces).collect():
            assert r["f"] == brute_fingerprint(r["t"], pieces)


def test_likeness_and_first_change(spark):
    rows = [("a. b. c. d.", "a. b. X. d."), ("same\n", "same\n"), ("p. q.", "r. s."), ("", "x")]
    df = spark.createDataFrame(rows, "x string, y string")
    df = merkle.add_fingerprint(merkle.add_fingerprint(df, "x", "fx"), "y", "fy")
    df = merkle.add_likeness(df, "fx", "fy", "near")
    got = [(r["near"], r["at"]) for r in df.select("near", merkle.first_changed_leaf(df.fx, df.fy).alias("at")).collect()]
    assert got == [(0.6, 2), (1.0, None), (0.0, 0), (0.0, 0)]


def test_edit_of_a_long_sentence_stays_local(spark):
    rng = random.Random(12)
    latin = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(latin) for _ in range(120))) for i in range(30)]
    rows += [(100 + i, "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(300))) for i in range(30)]
    for r in merkle.document_fingerprints(make(spark, rows)).collect():
        assert r["near_edited"] > 0.2, (r["doc_id"], r["near_edited"])
    texts = ["a\x01b", "a\x01\x02b", "a\x01\x03b", "ab", "", "\x01", "\n", "a b\n\nc. d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = df.select("t", F.split(merkle.mark_ends(F.col("t")), merkle.MARK).alias("p")).collect()
    assert all("".join(r["p"]) == r["t"].replace("\x01", "\x01\x02") for r in parts)
    roots = {r["f"].split(":")[0] for r in merkle.add_fingerprint(df, "t", "f", pieces=True).collect()}
    assert len(roots) == len(texts)


def test_merkle_runs_no_python(spark, odd_docs):
    plan = merkle.document_fingerprints(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
