import hashlib
import random
import re

from cairn.llm import decontamination, line_dedup, quality_rules, url_rules
from cairn.llm.queries import URL_RULES


def by_hand(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.com/en/7x?q", "https://com/en/", "http://xcom/en/1", "http://net/de", "http://b.net/de/#f", None, "no scheme/en/", "http://", "http:///en/", "http://example.net/de/81", "http://example.com/en/", "a://b://c.com/en/z", "http://..com/en/", "http://org/es/\n"] * 2
    frame = spark.createDataFrame([(i, u, "c", "k") for i, u in enumerate(urls)], "page_id long, url string, key string, path string")
    more = [*URL_RULES, ("example.com", "", "block"), ("a.example.com", "/en/", "allow"), ("example.com", "/en/7x", "block")]
    for rules in (URL_RULES, more, []):
        table = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
        got = url_rules.judge(frame, table, partitions=3).collect()
        assert len(got) == len(urls)
        assert all((r.host, r.path, r.rule, r.verdict) == by_hand(r.url, rules) for r in got)
    assert url_rules.judge(frame.limit(0), table).count() == 0


def test_one_hot_url(spark):
    frame = spark.range(3000).selectExpr("id as page_id", "if(id % 3 = 0, 'http://x.com/en/1', concat('http://h', id, '.org/es/')) as url")
    table = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_rules.judge(frame, table, partitions=7)
    assert (got.where("verdict = 'block'").count(), got.count()) == (3000, 3000)


def test_the_rules_are_those_of_the_contract(spark):
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{v} {h}{p}" for h, p, v in URL_RULES) == said
    urls = {"http://a.com/en/1": "block", "http://example.com/en/71": "allow", "http://a.net/de/1": "allow", "http://example.net/de/81": "block", "http://org/es/": "block", "http://a.net/fr/": "allow"}
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge(frame, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    assert {r.url: r.verdict for r in got.collect()} == urls
    assert [r.rule for r in got.where("url = 'http://a.net/de/1'").collect()] == ["net/de/"]


def rule_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    eight = "a b c d e f g h"
    texts = [None, "", " \t\n", "one", "x\ny\nx\n\n \nx", f"{eight} {eight}", f"{eight} i {eight} a b", "w " * 3000, "é\u00a0ü # <b> & |", "the cat and the dog of a man is in that house for it was on with be as by this", f"z {eight} " * 20]
    rows = [*enumerate(texts), (3, "one")]
    got = quality_rules.quality_rules(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((i, *rule_by_hand(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert [r.kept for r in got if r.doc_id == 9] == [True]
    assert quality_rules.quality_rules(docs([])).count() == 0


def test_stop_words_are_asked_of_their_script_only(spark, docs):
    chinese = " ".join("今天 我们 一起 去 公园 散步 然后 回家 吃饭 看书".split() * 3 + ["好"])
    russian = " ".join("мы вместе пошли в парк гулять потом вернулись домой обедать и читали книгу до вечера".split() * 2 + ["да"])
    junk = " ".join(f"zq{c} vx{c} kj{c}" for c in "abcdefghij")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.quality_rules(docs([(1, chinese), (2, russian), (3, junk)])).collect()}
    assert got[1][1] is (not got[1][0]) and got[2][1] is (not got[2][0]) and got[3] == (False, False)


def test_line_dedup_replaces_columns_of_its_names(spark, docs):
    frame = docs([(1, "a\nb"), (2, "a")]).selectExpr("*", "'x' AS n_lines", "'y' AS n_removed")
    got = line_dedup.dedup_lines(frame, min_sites=2)
    assert sorted(got.columns) == sorted(frame.columns)
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()} == {(1, "a\nb", 2, 0), (2, "", 1, 1)}


def lines_by_hand(rows, sites):
    where, first = {}, {}
    for i, t, s in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                where.setdefault(x.strip(), set()).update([s] if s else [])
                first[x.strip()] = min(first.get(x.strip(), (i, k)), (i, k))
    wide = {x for x, s in where.items() if len(s) >= sites}
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if x.strip() not in wide or first[x.strip()] == (i, k)) for i, t, _ in rows}


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  boiler \n\nrare {i % 3}\nboiler", f"s{i % 11}") for i in range(60)] + [(60, None, "s1"), (61, "", "s1"), (62, "boiler", None), (63, "x\r\nx", "s2")]
    for i in range(9):  # one site less than the threshold, and as many as it
        rows.append((100 + i, "nearly", f"t{i}"))
    rows += [(200 + i, "just", f"t{i}") for i in range(10)]
    frame = spark.createDataFrame([(i, t, "en", s, 0, "clash", 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, places string, h int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame, 10).collect()}
    assert {i: r.text for i, r in got.items()} == lines_by_hand(rows, 10)
    assert got[5].n_lines == 4 and got[5].n_removed == 3 and got[60].n_lines == 0 and got[5].places == "clash"
    assert sum(r.n_removed for i, r in got.items() if 200 <= i) == 9
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def hits_by_hand(docs, items, size=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(k)
    out = {}
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    found |= own
                    hit |= set(range(i, i + n))
        out[d] = (len(w), len(hit), len(found))
    return out


def test_decontamination(spark, docs):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "short One"), (3, None), (4, "..."), (10, long.upper()), (5, " ".join(["a"] * 15))]
    texts = [None, "", "...", f"x {long.replace(' ', ', ')} y", " ".join(f"w{i}" for i in range(5, 18)), " ".join(f"w{i}" for i in range(5, 17)), "is short-one, short one", "a " * 40, "é" + long, "w1 w2 " * 200 + long]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (16 << 20, 64):  # in one block, and in many
        got = {r.doc_id: r for r in decontamination.contamination(docs(rows), bench, block_bytes=block).collect()}
        assert {i: (r.n_words, r.n_hit, r.n_items) for i, r in got.items()} == hits_by_hand(rows, items)
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got.values())
    kept = decontamination.clean(docs(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated} and "id" in kept.columns
    assert decontamination.contamination(docs(rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(docs([]), bench).count() == 0


def test_items_without_an_id_or_with_other_ids(spark, docs):
    long, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "wv")
    rows = [(0, long), (1, other), (2, f"{long} {other}"), (3, "clean")]
    for kind, ids in (("long", (None, 7, None)), ("string", ("x-1", "10", None))):
        items = list(zip(ids, (long, other, long), strict=True))
        bench = spark.createDataFrame(items, f"item_id {kind}, text string")
        for block in (16 << 20, 64):
            got = {r.doc_id: r for r in decontamination.contamination(docs(rows), bench, block_bytes=block).collect()}
            assert {i: (r.n_words, r.n_hit, r.n_items) for i, r in got.items()} == hits_by_hand(rows, items)
            for i, r in got.items():  # the registered SQL leaves nulls out of the names
                want = sorted({str(k) for k, t in items if k is not None and t in rows[i][1]})
                assert r.items_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert {r.doc_id for r in decontamination.clean(docs(rows), bench).collect()} == {3}


def test_proximity(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "gamma x alpha beta"), (2, "alpha " + "x " * 20 + "beta gamma"), (3, "alpha beta"), (4, "gamma")]
    got = decontamination.phrase_hits(docs(rows), bench, slop=3)
    assert {r.doc_id for r in got.collect() if len(r["items"])} == {1}


def test_one_index_serves_many_searches(spark, docs):
    """Posting lists against plain scans, exact and near, for several sets of items over one stored index."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(25)}" for _ in range(n))
    rows = [(i, say(rng.randrange(0, 60))) for i in range(60)] + [(100, say(40_000)), (None, say(30)), (5, None)]
    index = decontamination.build_index(docs(rows))
    for size, n in ((3, 4), (4, 9), (13, 2)):
        items = [(k, say(n)) for k in range(6)]
        bench = spark.createDataFrame(items, "item_id long, text string")
        windows = {(k, tuple(w[i : i + size])) for k, t in items for w in [t.split()] for i in range(max(1, len(w) - size + 1))}
        exact = decontamination.search(index, bench, size).collect()
        near = decontamination.search(index, bench, size, slop=1, block_bytes=40).collect()

        def by_hand(text, slop, windows=windows):
            w, found = (text or "").split(), set()
            for k, win in windows:
                for i in range(len(w)):
                    part = w[i : i + len(win) + (slop or 0)]
                    if tuple(part[: len(win)]) == win if slop is None else set(win) <= set(part):
                        found.add(str(k))
                        break
            return sorted(found)

        for got, slop in ((exact, None), (near, 1)):
            assert sorted((str(r.key), list(r["items"])) for r in got) == sorted((str(i), by_hand(t, slop)) for i, t in rows)
