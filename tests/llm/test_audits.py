"""Source divergence, URL filters and Merkle manifests against plain loops and SQL, on odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from compare import connection, difference
from pyspark.sql import functions as F

from lectern.llm import divergence, merkle, url_filters
from lectern.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NEW = ("op11_source_divergence", "op12_url_filters", "op13_merkle_manifest")
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, `root` int, rank int"


@pytest.mark.parametrize("name", NEW)
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), ORACLES[name], connection(SF)) == ""


TEXTS = [
    None, "", " \n", "One two two", "one TWO three", "Two one, one-two", "three Äpfel ÄPFEL äpfel 日本語", "É é éÉ x1y\x00z", "word " * 20_000 + "one",
    "one\u00a0two\u2003three", "two", "two", "ONE", "Kelvin \u212a k",
]


@pytest.fixture(scope="module")
def odd():
    """Awkward rows, some twice, with null ids, sources and languages, and columns whose names operators use."""
    rows = [(i, [None, "", "a", "b", "Ä"][i % 5], [None, "en", "en", ""][i % 4], [None, -3, 7][i % 3], t, "x", 1, 2) for i, t in enumerate(TEXTS * 3)]
    return rows + rows[:9] + [(None, "a", "en", 1, "no id", "x", 1, 2), (-5, None, None, None, None, None, None, None), (5, "a", "en", 1, "A", "x", 1, 2), (5, "a", "en", 1, "a", "x", 1, 2)]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_merkle_manifest"])
def test_odd_documents(spark, odd, name):
    make = divergence.audit if name.startswith("op11") else merkle.manifest
    df = spark.createDataFrame(odd, DOCS).repartition(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in odd])
    assert difference(make(df), ORACLES[name], con) == ""
    assert make(df.limit(0)).count() == 0


# op11


def brute_audit(rows, ranks=divergence.RANKS):
    """All parts of the audit with whole numbers of any size."""
    docs, group, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang or ""].update(set(found))
        group[lang or "", source or ""].update(found)
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        share = {}
        whole = sum((group[lang, s] for s in sources), Counter())
        for s, counts in [(s, group[lang, s]) for s in sources] + [(None, whole)]:
            size = sum(counts[t] for t in kept) + len(kept)
            share[s] = {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(share[s][t], share[None][t]), t) for t in kept if group[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


def plain(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def words(rng, n, of):
    return " ".join(f"w{'abcdefghij'[w % 10]}{'klmnopqrst'[w // 10 % 10]}{'uvwxyzabcd'[w // 100]}" for w in (min(int(rng.paretovariate(0.6)), of) for _ in range(n)))


def test_audit_of_many_sources_in_several_blocks(spark):
    """More sources than a block has, one of them with a third of all rows, and languages that keep no term."""
    rng = random.Random(1)
    rows = [("en", "hot" if i % 3 == 0 else f"s{rng.randint(0, 149)}", words(rng, rng.randint(0, 30), 300)) for i in range(900)]
    rows += [("none", f"s{i}", f"only{i}") for i in range(4)] + [("none", "s1", None), ("one", "alone", "a a a"), (None, None, "b"), ("", "x", "b b"), ("", "", "b B")]
    assert divergence.SIDE < 150
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    assert plain(divergence.audit(df)) == brute_audit(rows)


def test_search_stops_before_all_terms_and_ties_are_whole(spark):
    rng = random.Random(2)
    rows = [("en", f"s{i % 3}", words(rng, 400, 990) + " tie" * (i % 3 == 1) + f" only{'abc'[i % 3]}" * 9) for i in range(120)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    groups, postings = divergence.counts(df)
    for ranks in (5, 20, 1000):
        found, evaluated = divergence.top_terms(postings, ranks)
        got = sorted((r["source"], r["item"], r["value"], r["rank"]) for r in found.collect())
        assert got == sorted((s, item, v, k) for _, s, part, item, v, k in brute_audit(rows, ranks) if part == "term")
        took = evaluated.agg(F.sum("many")).first()[0]
        above = postings.where("p > q").count()
        assert took < 0.5 * above if ranks == 5 else took <= above


def test_shares_are_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**13, 10**14 + 7, 3), (0, 1, 2), (10**15, 10**15 + 1, 999)], "n long, size long, v long")
    got = [r["p"] for r in rows.select("n", "size", "v", divergence._share("n", "size").alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 1) // (size + v) for n, size, v in ((10**13, 10**14 + 7, 3), (0, 1, 2), (10**15, 10**15 + 1, 999))]


# op12

URLS = [
    None, "", "no scheme casino", "http://", "http://org", "http://ORG/", "http://x.org/", "http://xorg/", "https://a.Example.ORG/es/1?q=#f", "https://example.org/es", "http://example.org/en/12",
    "http://example.org/en/2", "http://a.com/fr/x", "http://com/fr/casino", "http://a.com/de/", "http://a.com/", "http://a.com:80/fr/", "http://u@b.org/x", "http://a.net?x=://casino", "http://casino.net",
    "http://CASINO.net", "http://casinos-x.net", "http://mycasino.net", "http://casino1.net", "http://cheap.net/cheapest", "http://cheap.net/pills", "http://free.net/free-free", "http://a.net/%63asino", "http://a.net/%2563asino",
    "http://a.net/free%20porn", "http://a.net/adult-education", "http://a.net/adult--education", "http://a.net/young-adult-education", "http://a.net/adult-education/adult", "http://essex.net/sex", "http://sex.net/win",
    "http://é.net/écasino", "http://a.net/casinoé", "http://a.net/%zz%4", "http://a.org./x", "http://.org/x", "://casino", "http://a.net/anti-spam-filter", "http://a.net/spam+filter_spam", "x://a.net/\ncasino\n",
    "http://a.net/" + "free/" * 40_000 + "pills", "http://a.net/" + "adult-education-" * 20_000 + "z",
]


def test_odd_urls(spark):
    rows = [(i, u, "<html>", "x") for i, u in enumerate(URLS * 2)] + [(None, "http://casino.net", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    assert difference(url_filters.filter_urls(df), ORACLES["op12_url_filters"], con) == ""
    assert url_filters.filter_urls(df.limit(0)).count() == 0
    kept = url_filters.keep_allowed(df)
    blocked = url_filters.filter_urls(df).where("verdict = 'block'").count()
    assert kept.columns == df.columns and kept.count() == len(rows) - blocked and blocked > 10


def test_urls_are_judged_as_by_single_searches():
    """Every term and phrase is looked for by itself; hits within a phrase are left out."""
    rng = random.Random(4)
    vocabulary = url_filters.Vocabulary(url_filters.STRICT, url_filters.SOFT, url_filters.SAFE)
    spellings = {w: (t, n) for lines, n in ((url_filters.SOFT, 1), (url_filters.STRICT, 2)) for w, t in url_filters.spellings(lines).items()}
    safe = url_filters.SAFE.strip().splitlines()
    for _ in range(1500):
        some = rng.choices([*spellings, *safe, "x", "example", "é", "9"], k=rng.randint(1, 6))
        url = "http://" + "".join(w.replace(" ", rng.choice("-_+ ")) + rng.choice(["", "-", ".", "/", "%20", "--", "3"]) for w in some)
        text = " " + re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", re.sub("%20", " ", url.lower())) + " "
        at = lambda word: [(m.start() + 1, m.start() + 1 + len(word)) for m in re.finditer(f"(?= {re.escape(word)} )", text)]
        covers = [span for phrase in safe for span in at(phrase)]
        want = {}
        for word, (term, weight) in spellings.items():
            if any(not any(a <= x and y <= b for a, b in covers) for x, y in at(word)):
                want[term] = weight
        assert vocabulary.terms(url) == want, url


def test_longest_rule_wins_whatever_their_order():
    rng = random.Random(5)
    hosts, paths = ("org", "a.org", "b.a.org", "com"), ("", "/", "/x", "/x/y")
    for _ in range(500):
        chosen = {(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(5)}
        rules = tuple(url_filters.Rule(h, p, v) for (h, p), v in chosen.items())
        host, path = rng.choice([*hosts, "c.b.a.org", "xa.org", "org.com", ""]), rng.choice([*paths, "/x/y/z", "/xy"])
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        assert url_filters.Rules(rules).fitting(host, path) == max(fit, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)


# op13


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(map(said, (doc_id, source, lang, n_chars, text))))


def tree(leaves):
    """The root, and each leaf's runs of siblings with its own place in them, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append((run[: i % 16], run[i % 16 + 1 :]))
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0] is not None, r[0], leaf_of(*r[:5]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[s] = tree([x[2] for x in sources[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, doc, leaf, r), path in zip(sources[s], trees[s][1]):
            siblings = [*path, *top]
            text = r[4] if doc is None or zlib.crc32(str(doc).encode()) % 5 or r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            folded = leaf_of(*r[:4], text)
            for before, after in siblings:
                folded = h("".join([*before, folded, *after]))
            out.append((doc, leaf, trees[s][0], root, h("".join("".join([*b, *a]) for b, a in siblings)), folded, folded == root))
    return out


def test_manifest_of_every_size(spark):
    """Sources of 1 to more leaves than two blocks hold, at the edges of runs and blocks, and 40 sources."""
    sizes = [1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097, 8200, *([3] * 27), 0]
    rows, doc = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((doc, None if s == 3 else f"s{s}", "en", doc % 7, f"Text {doc}" if doc % 3 else "small"))
            doc += 1
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = sorted(tuple(r[c] for c in names) for r in merkle.manifest(df).collect())
    assert got == sorted(brute_manifest(rows))
    assert {r[-1] for r in got} == {True, False}


def test_one_document_and_one_source(spark):
    one = [(7, "a", None, None, "T")]
    df = spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string")
    [r] = merkle.manifest(df).collect()
    assert tuple(r) == brute_manifest(one)[0] and r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h("")


def test_climbing_is_a_tree_of_any_height():
    for n in (1, 2, 16, 17, 255, 256, 257, 4095, 4096):
        leaves = [h(str(i)) for i in range(n)]
        root, paths = merkle.climb(leaves, merkle.height(n))
        want, siblings = tree(leaves)
        assert root == want and paths == [["".join(x) for pair in p for x in pair] for p in siblings]
        assert all(merkle.fold(x, p) == root for x, p in zip(leaves, paths))


# Spans of secrets


def test_spans_are_cut_as_by_single_characters():
    from lectern.llm import spans

    rng = random.Random(6)
    for _ in range(400):
        others = [(a, a + rng.randint(1, 9), "o") for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        edges = sorted(rng.sample(range(70), 2 * rng.randint(0, 6)))
        own = [(a, b, "s") for a, b in zip(edges[::2], edges[1::2])]
        held = {i for a, b, _ in others for i in range(a, b)}
        want = [(i, "s") for a, b, _ in own for i in range(a, b) if i not in held]
        got = spans.cut(own, others)
        assert [(i, k) for a, b, k in got for i in range(a, b)] == want and all(a < b for a, b, _ in got)


def test_short_secrets_identifiers_and_what_stays_of_a_string():
    import string

    from lectern.llm import secrets

    rng = random.Random(7)
    for n, least in ((12, 0.7), (16, 0.8)):
        made = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for _ in range(400)]
        assert sum(bool(secrets.random_spans(f"so {s} it")) for s in made) >= least * len(made)
    for s in (
        "s3-us-west-2-prod-db-replica-03 ISO_8859_1_DECODER_TABLE_XX 2024-05-12T10-33-20-backup-01a abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
        "abcdefghijklmnopqrstuvwxyz0123456789 qwertyuiopasdfghjklzxcvbnm utf8mb4_unicode_ci x86_64-linux-gnu IMG_20240512_103320 HTTP_404_NOT_FOUND ProductID12345 "
        "ISBN9780306406157 libstdc++6-dbg GL_TEXTURE_2D_ARRAY_EXT CVE-2021-44228 kubernetes1234 December2024 iPhone15ProMax abc123def456 20240512T103320Z"
    ).split():
        assert secrets.random_spans(f"a {s} b") == [], s
    key = "ZkQ" + "0123456789abcdef0123456789" + "XqW7rT2pLmVb8sYdNcHf4GjK"
    base, more = secrets.spans_of(f"it {key} is")
    assert [k for _, _, k in base] == ["hex"] and [(a - 3, b - 3) for a, b, _ in more] == [(0, 3), (29, len(key))]
    assert secrets.replaced(f"it {key} is", [*base, *more]) == "it [random][hex][random] is"
