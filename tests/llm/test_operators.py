"""Each operator against a plain, independent version over whole texts, and on rows that are null, empty, long, repeated."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyhouse.llm import (
    attribution,
    chat,
    decontamination,
    html_extraction,
    licenses,
    lines,
    oracles,
    packing,
    quality,
    simhash,
    tokens,
    training_order,
)
from tallyhouse.llm.components import components

FIXTURE = "/root/testdata/sf0.001"
SEARCH = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PLAIN = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def collected(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def same(found, expected) -> None:
    assert Counter(map(repr, found)) == Counter(map(repr, expected))


# 1


def test_chat_is_read_back(spark):
    conversations = spark.read.parquet(f"{FIXTURE}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [
        (-1, 0, "user", "### User: </turn>\n \\ \\\\"),
        (-1, 1, "assistant", "### ### Role x: </turn"),
        (-2, 0, "to: ol\\### ", " </turn>\n"),
        (-2, None, None, None),
        (-2, 0, "assistant", "\\"),
        (-2, 0, "assistant", "\\"),
        (None, 1, "user", "é" * 50_000),
    ]
    given = conversations.union(spark.createDataFrame(odd, conversations.schema))
    turns = defaultdict(list)
    for conv_id, turn, role, text in given.collect():
        turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    expected = []
    for conv_id, own in turns.items():
        own.sort()
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, _, role, t in own)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
        expected.append((conv_id, len(own), sha[0], len(loss), sha[1]))
    segments = chat.segments(given)
    back = chat.read_back(segments)
    same(collected(back.drop("formatted_chars", "valid")), expected)
    chars = {r[0]: r[1] for r in segments.groupBy("conv_id").agg(F.sum(F.length("text"))).collect()}
    assert {r.conv_id: r.formatted_chars for r in back.collect()} == chars


@pytest.mark.parametrize(
    ("roles", "valid"),
    [("ua", True), ("sua", True), ("uaua", True), ("u", False), ("au", False), ("uua", False), ("sau", False), ("uxa", False)],
)
def test_turn_order(frame, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    given = frame("conv_id long, turn long, role string, text string", *((1, i, names[r], "t") for i, r in enumerate(roles)))
    assert chat.read_back(chat.segments(given)).first().valid is valid


def test_chat_of_an_empty_table(frame):
    given = frame("conv_id long, turn long, role string, text string, loss int")
    assert chat.read_back(chat.segments(given)).count() == 0


# 2


def plain_measures(text):
    words = PLAIN.findall(text or "")
    own = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(own)
    covered = {i + k for i, w in enumerate(own) if count[w] > 1 for k in range(3)}
    full = [line for line in (text or "").split("\n") if PLAIN.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        sum(line in full[:i] for i, line in enumerate(full)) if len(full) < 2000 else len(full) - len(set(full)),
        len(covered),
    )


def test_quality_counts(docs, rows):
    found = quality.judged(docs).select("doc_id", *quality.COUNTS, "base_failed")
    expected = []
    for doc_id, text, _ in rows:
        m = plain_measures(text)
        expected.append((doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    same(collected(found), expected)


def test_bad_hosts_go_and_good_ones_stay(frame):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    given = [(i, good, "fine") for i in range(300)] + [(1000 + i, bad if i % 20 else good, "junk") for i in range(400)]
    given += [(2000, good, None), (2001, good, "tiny"), (2002, bad, "tiny2")]
    df = frame("doc_id long, text string, source string, lang string", *((*g, "x") for g in given))
    kept = {r.doc_id for r in quality.judged(df).where("kept").collect()}
    assert kept == {*range(300), 2000, 2001}
    same(collected(quality.kept_documents(df).select("doc_id")), [(i,) for i in kept])


def test_hosts_fail_by_rule(frame, tmp_path, monkeypatch):
    """Hosts that fail one rule throughout go for that rule, also where no document of theirs fails alone; against the SQL."""
    plain = " ".join(f"w{i}" for i in range(60))
    loud = " ".join(f"w{i} #" if i % 3 == 0 else f"w{i}" for i in range(60))
    looped = "a b c d e f " * 20
    stuttering = "\n".join(f"x{i // 8 * 8}" if i % 8 < 3 else f"w{i}" for i in range(80))
    given = [(i, plain, "fine") for i in range(300)] + [(1000 + i, loud if i % 20 else plain, "loud") for i in range(400)]
    given += [(2000 + i, looped if i % 20 else plain, "looped") for i in range(400)] + [(3000 + i, stuttering, "stutters") for i in range(400)]
    given += [(4000, plain, None), (4001, loud, "tiny"), (4002, None, "tiny"), (4002, None, "tiny")]
    df = frame("doc_id long, text string, source string", *given).coalesce(2)
    found = quality.judged(df)
    verdicts = {r.host: r.host_rules for r in found.select("host", "host_rules").distinct().collect()}
    assert verdicts == {"fine": "", "loud": "symbols", "looped": "base,repetitive", "stutters": "lines", None: "", "tiny": ""}
    kept = found.where("kept").select("doc_id")
    same(collected(kept), [(i,) for i in (*range(300), 4000, 4001)])
    same(collected(quality.kept_documents(df).select("doc_id")), collected(kept))
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    same(collected(quality.judged(df)), collected(found))
    same(collected(quality.kept_documents(df).select("doc_id")), collected(kept))
    df.write.parquet(str(tmp_path / "documents"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
        expected = db.execute(oracles.SQL["op2_quality_rules"])
        names = [c[0] for c in expected.description]
        same(collected(found.select(*names)), expected.fetchall())


# 3


def test_labelled_pages_held_out():
    pages = [html_extraction.labelled_page(random.Random(10**9 + i)) for i in range(100)]
    f, labels = html_extraction.training_forest(pages)
    found = html_extraction.trained().marginals(f)[0][:, 1] >= 0.5
    runs = f.kind == 1
    assert (found == labels)[runs].mean() > 0.98


def test_marginals_against_enumeration():
    trees = [html_extraction.parsed("<div>a<p>b</p></div><ul><li>c</ul>")]
    f, texts, _ = html_extraction.forest(trees)
    r = np.random.default_rng(1)
    model = html_extraction.Model(r.normal(size=html_extraction.N_FEATURES), r.normal(size=(2, 2, 2)))
    n = len(f.parent)
    unary = np.bincount(f.node, weights=model.unary[f.feature], minlength=n)
    weights = np.zeros((n, 2))
    for state in range(1 << n):
        y = [(state >> i) & 1 for i in range(n)]
        score = sum(unary[i] * y[i] for i in range(n))
        score += sum(model.pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
        for i in range(n):
            weights[i, y[i]] += np.exp(score)
    assert np.allclose(model.marginals(f)[0], weights / weights.sum(axis=1, keepdims=True))


def test_pages(spark):
    import html

    pages = spark.read.parquet(f"{FIXTURE}/pages.parquet")
    odd = [
        (-1, None, None),
        (-2, "", ""),
        (-3, "u", "<p>"),
        (-4, "u", "<<<>><div" * 50),
        (-5, "u", "<article><p>One &amp; two&nbsp;&#x41;<br>three <b>b</b>old. More of it here, and a sentence.<p>Next one. " + "It is long. " * 9000 + "</article><nav><a href=x>no</a></nav>"),
    ]
    given = pages.union(spark.createDataFrame(odd, pages.schema))
    found = {r.page_id: r for r in html_extraction.extracted(given).collect()}
    for page_id, _, source in pages.collect():
        inner = re.search("<article>(.*?)</article>", source, re.S)[1]
        blocks = [html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))) for x in re.split("</?(?:p|h1)>", inner)]
        text = "\n".join(t for b in blocks if (t := " ".join(b.split())))
        assert found[page_id].text == text
        assert found[page_id].n_chars == len(text)
    assert found[-1].text == found[-2].text == found[-3].text == ""
    assert found[-5].text == "One & two A three bold. More of it here, and a sentence.\nNext one. " + ("It is long. " * 9000).strip()


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>x</title><p>Article <b>one</b>.<p>Two.", ["Article one.", "Two."]),
        ("<head><meta charset=x><script>var a = '<p>'</script><style>p {}</style>Plain text<p>Two.", ["Plain text", "Two."]),
        ("<head><noscript><img src=x></noscript><title>t</title></head><body><p>One<svg><title>no</title></svg> two.", ["One two."]),
        ("<head><script src=x /><title>t</title></head><body><p>One.<p>Two.", ["One.", "Two."]),
        ("<p>A one.<svg><title>x</svg><p>Article two.", ["A one.", "Article two."]),
        ("<p>A one.<svg><style>a{}</svg><p>Article two.", ["A one.", "Article two."]),
        ("<p>A one.<noscript><iframe src=x></noscript><p>Article two.", ["A one.", "Article two."]),
        ("<p>A one.<svg><g></title><text>junk</text></svg><p>Article two.", ["A one.", "Article two."]),
        ("<p>A one.<math><svg></math><p>Two.</svg> Three.", ["A one.", "Two. Three."]),
        ("<head><noscript><style>p{}</noscript><p>One.", ["One."]),
        ("<p>One.<script>if (a < b) '</svg><p>'</script><p>Two.", ["One.", "Two."]),
        ("<p>One.<svg viewBox=x /><p>Two.<iframe src=x /><canvas/><p>Three.", ["One.", "Two.", "Three."]),
    ],
)
def test_nothing_but_hidden_elements_is_hidden(page, texts):
    assert [t for t in html_extraction.parsed(page).blocks() if t] == texts


def test_repeated_pages_and_clashing_columns(frame):
    names = "page_id long, url string, html string, text string, n_chars int, tag int, label int"
    row = (1, "u", "<body><article><p>One long sentence of the article, and more of it here.</article>", "x", 1, 2, 3)
    found = html_extraction.extracted(frame(names, row, row, (None, None, row[2], *row[3:])))
    assert found.columns[:4] == ["page_id", "url", "text", "n_chars"]
    text = "One long sentence of the article, and more of it here."
    same([tuple(r)[:4] for r in found.collect()], [(1, "u", text, len(text))] * 2 + [(None, None, text, len(text))])


# 4


def plain_fingerprint(text, size=3):
    words = [w.translate(LOWER) for w in PLAIN.findall(text or "")]
    if not words:
        return 0
    own = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=3):
    """Smallest member by brute force over distinct prints."""
    own = sorted(set(prints))
    parent = {p: p for p in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    return {p: root(p) for p in own}


def test_near_duplicates(docs, rows):
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    roots = linked(prints)
    smallest = {}
    for (doc_id, _, _), p in zip(rows, prints):
        if doc_id is not None:
            smallest[roots[p]] = min(doc_id, smallest.get(roots[p], doc_id))
    expected = [(d, f"{p:016x}", smallest.get(roots[p])) for (d, _, _), p in zip(rows, prints)]
    same(collected(simhash.near_duplicates(docs)), expected)
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    assert Counter(r.doc_id for r in one.collect()) == Counter(smallest.get(r) for r in set(roots.values()))


def test_hash_is_the_same_as_sparks(spark):
    assert spark.sql("SELECT xxhash64('a b ç') AS h").first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b ç", 42)


@pytest.mark.parametrize("dense, split", [(2, 4), (2, 1000), (64, 1000), (16, 64)])
def test_links_connect_all_within_the_radius(spark, dense, split):
    r = random.Random(dense)
    values = {sum(1 << b for b in r.sample(range(12, 30), r.choice([2, 4, 9, 13]))) for _ in range(400)}
    for _ in range(8):
        x = r.getrandbits(64)
        for _ in range(60):
            values.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 3, 4])))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    found = simhash._spanning(np.array(sorted(values), dtype=np.uint64), 3)
    assert all((sorted(values)[a] ^ sorted(values)[b]).bit_count() <= 3 for a, b in found)
    pairs = collected(simhash.links(df, dense=dense, split=split))
    assert len(pairs) == len(set(pairs))
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and a < b for a, b in pairs)
    for links in ([(sorted(values)[a], sorted(values)[b]) for a, b in found], [(a % (1 << 64), b % (1 << 64)) for a, b in pairs]):
        parent = {v: v for v in values}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        groups = defaultdict(set)
        for v in values:
            groups[root(v)].add(v)
        expected = defaultdict(set)
        for v, k in linked(values).items():
            expected[k].add(v)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in expected.values()}


def test_components_of_a_long_chain_and_a_star(spark):
    r = random.Random(5)
    ids = list(range(400))
    r.shuffle(ids)
    links = list(zip(ids, ids[1:])) + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, None)]
    found = {a: b for a, b in collected(components(spark.createDataFrame(links, "src bigint, dst bigint").repartition(7)))}
    assert found == {**dict.fromkeys(ids, 0), **{1000 + i: 1000 for i in range(300)}}


# 5


def test_contamination(spark, docs, rows):
    benchmark = spark.read.parquet(f"{FIXTURE}/benchmark.parquet")
    odd = [(7001, "w1"), (7002, None), (7003, "-- !"), (None, "MIT License"), (7001, "by NC")]
    benchmark = benchmark.union(spark.createDataFrame(odd, benchmark.schema))
    items = defaultdict(set)
    for item, text in benchmark.collect():
        words = SEARCH.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - 9) if words else 0):
            items[tuple(words[i : i + 10])].add("null" if item is None else str(item))
    sizes = {len(k) for k in items}
    expected = []
    for doc_id, text, _ in rows:
        words = SEARCH.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if ids := items.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected.append((doc_id, len(words), len(hit), len(found), sha, bool(hit)))
    assert any(e[-1] for e in expected)
    same(collected(decontamination.digest(decontamination.contamination(docs, benchmark))), expected)
    small = decontamination.contamination(docs, benchmark, pass_words=20_000)
    same(collected(decontamination.digest(small)), expected)
    for pass_words in (decontamination.PASS_WORDS, 20_000):
        clean = decontamination.clean_documents(docs, benchmark, pass_words=pass_words)
        assert clean.columns == docs.columns
        same(collected(clean.select("doc_id")), [(e[0],) for e in expected if not e[-1]])


def test_copies_of_one_item_share_no_memory(spark):
    """A third of the benchmark is one item: it is searched once, in as few passes."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    items = [(i, f"x{i} y z") for i in range(60)] + [(7, "c d e f g h i j k l")] * 30 + [(8, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs, benchmark, pass_words=200)
    assert collected(decontamination.digest(found))[0][:4] == (1, 12, 10, 1)


# 6


def test_token_counts_against_offsets_of_another_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    cut = F.coalesce(F.length("text"), F.lit(0))
    parts = [("a", F.lit(0), (cut / 3).cast("int")), ("b", (cut / 3).cast("int"), (cut / 2).cast("int"))]
    sections = F.array(*(F.struct(F.lit(n).alias("name"), a.cast("int").alias("start"), b.cast("int").alias("stop")) for n, a, b in parts))
    found = {rule: collected(attribution.token_counts(docs, sections, rule=rule)) for rule in attribution.RULES}
    expected = {rule: [] for rule in attribution.RULES}
    for doc_id, text, _ in rows:
        text = text or ""
        n = len(text)
        spans = [("a", 0, n // 3), ("b", n // 3, n // 2)]
        owner = ["a"] * (n // 3) + ["b"] * (n // 2 - n // 3) + ["rest"] * (n - n // 2)
        counts = {rule: Counter() for rule in attribution.RULES}
        for a, b in library.encode(text, add_special_tokens=False).offsets:
            chars = owner[a:b]
            counts["start"][chars[0]] += 1
            most = max(Counter(chars).items(), key=lambda x: (x[1], -chars.index(x[0])))[0]
            counts["majority"][most] += 1
            for c in chars:
                counts["split"][c] += 1 / len(chars)
        for rule, count in counts.items():
            expected[rule] += [(doc_id, name, a, b, count[name]) for name, a, b in [*spans, ("rest", 0, n)]]
    for rule in ("start", "majority"):
        same(found[rule], expected[rule])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4])
    for f, e in zip(sorted(found["split"], key=key), sorted(expected["split"], key=key)):
        assert f[:4] == e[:4] and f[4] == pytest.approx(e[4])


# 7


def test_license_base_places(docs, rows):
    found = {(r[0], i): r for i, r in enumerate(collected(licenses.scanned(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")))}
    expected = []
    for doc_id, text, _ in rows:
        words = SEARCH.findall((text or "").translate(LOWER))
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = sorted(i for i, _ in places)
        expected.append((doc_id, len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))))
    same(found.values(), expected)
    assert any(e[2] > 1 for e in expected)


def test_license_texts_by_diagonals(frame):
    body = licenses.TEMPLATES["bsd"]
    changed = body.split()
    changed[10:10] = ["really", "very"]
    changed[25] = "odd"
    given = frame(
        "doc_id long, text string",
        (1, "x y " + body.title() + " z"),
        (2, " ".join(changed)),
        (3, " ".join(body.split()[:9])),
        (4, body[:150] + " filler " * 30 + "no"),
        (None, body),
        (1, "x y " + body.title() + " z"),
    )
    found = collected(licenses.scanned(given).select("doc_id", "labels", "base_labels", F.round("score", 2)))
    by_id = {r[0]: r for r in found}
    assert len(found) == 6 and by_id[1][1:] == ("bsd", "", 1.0) and by_id[None][1] == "bsd"
    assert by_id[2][1] == "bsd" and 0.6 < by_id[2][3] < 1
    assert by_id[3][1] == "" and by_id[4][1] == ""


def test_relatives_of_a_license_are_told_apart(frame):
    notice = "This work is licensed under a Creative Commons {} International License."
    gpl, apache = licenses.TEMPLATES["gpl"], licenses.TEMPLATES["apache-2"]
    cases = {
        notice.format("Attribution 4.0"): "cc-by",
        notice.format("Attribution-NonCommercial 4.0"): "cc-by-nc",
        notice.format("Attribution-Non-Commercial 4.0"): "cc-by-nc",
        notice.format("Attribution-ShareAlike 4.0"): "",
        notice.format("Attribution-NonCommercial-ShareAlike 4.0"): "",
        notice.format("Attribution-NoDerivatives 4.0"): "",
        notice.format("Attribution 3.0").replace("International", "Unported"): "cc-by",
        notice.format("Attribution-ShareAlike 3.0").replace("International", "Unported"): "",
        notice.format("Attribution 4.0") + " No commercial or noncommercial warranty.": "cc-by",
        notice.format("Attribution-ShareAlike 4.0") + " " + "word " * 30 + notice.format("Attribution 4.0"): "cc-by",
        notice.format("Attribution 4.0") + " " + "word " * 30 + notice.format("Attribution-NonCommercial 4.0"): "cc-by,cc-by-nc",
        gpl: "gpl",
        gpl.replace("gnu general", "gnu lesser general"): "",
        apache: "apache-2",
        apache.replace("version 2 0", "version 1 1").replace("license 2 0", "license 1 1"): "",
    }
    given = frame("doc_id long, text string", *enumerate(cases), (None, notice.format("Attribution 4.0")))
    found = dict(collected(licenses.scanned(given, phrases={"no such phrase": "x"}).select("doc_id", "labels")))
    assert found == {**dict(enumerate(cases.values())), None: "cc-by"}


#: Notices and licenses with the label that the method finds; altered and negated ones have none.
NOTICES = {
    licenses.TEMPLATES["mit"]: "mit",
    licenses.TEMPLATES["mit"].replace("without restriction", "for noncommercial purposes only"): "",
    licenses.TEMPLATES["mit"].replace("without restriction", "with restriction"): "",
    licenses.TEMPLATES["mit"].replace("documentation files", "documentation files and odd data"): "mit",
    " ".join(licenses.TEMPLATES["mit"].split()[:40]): "mit",
    licenses.TEMPLATES["bsd"].replace("are permitted", "are not permitted"): "",
    licenses.TEMPLATES["bsd"].replace("with or without", "with"): "",
    licenses.TEMPLATES["bsd"] + " this is not all": "bsd",
    licenses.TEMPLATES["gpl"].replace("you can", "you can not"): "",
    licenses.TEMPLATES["gpl"].replace("version 3", "version 2"): "gpl",
    licenses.TEMPLATES["apache-2"].replace("except in", "in"): "",
    licenses.TEMPLATES["cc-by"].replace("is licensed", "is not licensed"): "",
    licenses.TEMPLATES["cc-by"].replace("this work is", "all images are"): "cc-by",
    licenses.TEMPLATES["cc-by-nc"].replace("noncommercial", "non commercial"): "cc-by-nc",
    licenses.TEMPLATES["cc-by-nc"].replace("noncommercial", "nc sa"): "",
    "not a license without words": "",
}


def test_altered_licenses_have_no_label(frame, tmp_path):
    """Also against the SQL, as the test tables hold phrases but no license texts."""
    rows = [*enumerate(NOTICES), (90, None), (91, ""), (92, licenses.TEMPLATES["mit"] + " x " * 20 + licenses.TEMPLATES["gpl"].upper())]
    given = frame("doc_id long, text string", *rows).coalesce(1)
    found = licenses.scanned(given, phrases={"no such phrase": "x"}).select("doc_id", "labels")
    assert dict(collected(found)) == {**dict(enumerate(NOTICES.values())), 90: "", 91: "", 92: "gpl,mit"}
    given.write.parquet(str(tmp_path / "documents"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
        same(collected(licenses.scanned(given)), db.execute(oracles.SQL["op7_license_scans"]).fetchall())


def test_every_span_of_a_license_is_returned(frame):
    size = len(licenses.TEMPLATES["bsd"].split())
    text = "x " + " notice of another ".join([licenses.TEMPLATES["bsd"]] * 5)
    given = frame("doc_id long, text string", (1, text), (None, text), (None, text))
    found = collected(licenses.spans(given).select("doc_id", "template", "first", "last", "score"))
    at = [1 + i * (size + 3) for i in range(5)]
    same(found, [(d, "bsd", a, a + size - 1, 1.0) for d in (1, None) for a in at])


# 8


def plain_deduplicated(rows):
    """By dictionaries over whole chunk texts: the first place of each, then what stands elsewhere later."""
    keyed = {(d is not None, d or 0, xxhash.xxh64_intdigest((t or "").encode(), 42), t) for d, t, _ in rows}
    key = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0) if t is not None else 42
    order = sorted(((named, d, key(t), t) for named, d, _, t in keyed), key=lambda x: x[:3])
    places, cleaned = {}, {}
    spans = [lines.chunks(t.split("\n") if t else []) for *_, t in order]
    for number, (*_, text) in enumerate(order):
        for a, b in spans[number]:
            places.setdefault("\n".join(text.split("\n")[a:b]), (number, a, b))
    for number, (named, d, _, text) in enumerate(order):
        own, gone = (text or "").split("\n"), set()
        for a, b in spans[number]:
            at, _, stop = places["\n".join(own[a:b])]
            if at != number or a >= stop:
                gone |= set(range(a, b))
        left = "\n".join(x for i, x in enumerate(own) if i not in gone)
        cleaned[named, d, text] = (text if text is None else left, len(gone))
    return [(d, *cleaned[d is not None, d or 0, t]) for d, t, _ in rows]


def test_line_dedup(spark, docs):
    passage = "first line here\nsecond line of it\nthird one\nfourth and last\nfifth"
    more = [(8000 + i, f"own {i}\n{passage}\nend {i}", None) for i in range(40)] + [(8100, passage + "\n" + passage, None)]
    given = docs.union(spark.createDataFrame(more, docs.schema))
    rows = [tuple(r) for r in given.collect()]
    found = lines.deduplicated(given, removed_column="n_removed")
    same(collected(found.select("doc_id", "text", "n_removed")), plain_deduplicated(rows))
    assert found.where("n_removed > 0").count() > 20


def plain_runs(rows):
    """Lines in runs of two lines or more, blank ones aside, that an earlier text or the lines before hold, longest runs first."""
    seen, gone = set(), {}
    for d, text in rows:
        own = (text or "").split("\n")
        full = [i for i, line in enumerate(own) if line.strip()]
        gone[d] = set()
        ends = defaultdict(list)
        for k, a in enumerate(full):
            for b in reversed(full[k + 1 : k + 12]):
                run = "\n".join(own[a : b + 1])
                if run in seen:
                    gone[d] |= set(range(a, b + 1))
                    break
            for b in full[k + 1 : k + 12]:
                ends[b].append("\n".join(own[a : b + 1]))
            seen.update(ends.pop(a - 1, ()))
        for runs in ends.values():
            seen.update(runs)
    return gone


def test_whole_passages_against_all_runs(frame):
    r = random.Random(5)
    own = lambda: f"line {r.random()}"
    passages = [[own() if r.random() < 0.8 else "" for _ in range(r.randint(2, 7))] for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [own() for _ in range(r.randint(0, 2))]
        for p in r.sample(passages, r.randint(0, 2)):
            cut = r.choice([0, 0, 1])
            parts += p[cut:] + [own() for _ in range(r.randint(0, 2))]
        texts.append("\n".join(parts))
    texts += ["x\nx\nx", "y\ny\ny\ny", "one line", "one line", "h\n\none line", "h\n\none line\n\n"]
    # One passage at a text's start, end, middle and alone.
    whole = "first of it\nsecond\n\nthird one\nfourth and last"
    texts += [whole, f"a\n{whole}\nb", f"{whole}\nc", f"d\n{whole}"]
    given = list(enumerate(texts))
    found = dict(collected(lines.deduplicated(frame("doc_id long, text string", *given)).select("doc_id", "text")))
    assert found == {d: t for d, t, _ in plain_deduplicated([(*g, None) for g in given])}
    # Next to nothing of what brute force finds stays, and nothing else goes.
    runs = plain_runs(given)
    wanted = gone = 0
    for d, text in given:
        left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in runs[d])
        wanted += len(text) - len(left)
        gone += len(text) - len(found[d])
        # Brute force compares no lines of one run with each other.
        assert len(found[d]) >= len(left) or len({*text.split("\n")}) == 1
    assert gone >= 0.95 * wanted
    n = len(texts)
    assert [found[i] for i in range(n - 4, n)] == [whole, "a\nb", "c", "d"]
    assert set("\n".join(texts).split("\n")) - {""} == set("\n".join(found.values()).split("\n")) - {""}


@pytest.mark.parametrize("bits", [1, 6, 64])
def test_colliding_hashes_are_compared_by_bytes(frame, bits):
    """With few bits all lines share their hashes with others."""
    given = frame("doc_id long, text string", (1, "a\nb"), (2, "c\nd"), (3, "a\nb"), (4, "e\nf"), (5, "a\n \nb"), (6, None))
    found = dict(collected(lines.deduplicated(given, hash_bits=bits).select("doc_id", "text")))
    assert found == {1: "a\nb", 2: "c\nd", 3: "", 4: "e\nf", 5: "a\n \nb", 6: None}
    assert (len(lines.ambiguous_hashes(given, hash_bits=bits)) > 0) == (bits < 64)


def test_boundaries_resist_shifts():
    r = random.Random(1)
    own = [f"line {r.random()}" for _ in range(200)]
    whole, moved = lines.chunks(own), lines.chunks(["x", *own])
    shifted = {(a - 1, b - 1) for a, b in moved}
    assert len(shifted & set(whole)) > 0.9 * len(whole)
    assert {i for a, b in whole for i in range(a, b)} == set(range(200))
    equal = lines.chunks(["same"] * 5000)
    assert len(equal) < 10_000 and max(b - a for a, b in equal) <= lines.MOST_LINES


def test_recall_of_repeated_runs():
    """Runs of two lines or more of earlier texts, by brute force over the fixture's documents."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    given = sorted({t: d for d, t in zip(table["doc_id"], table["text"]) if t}.items(), key=lambda x: x[1])
    given = [(d, t, None) for t, d in given]
    runs = plain_runs([g[:2] for g in given])
    gone = {d: n for d, _, n in plain_deduplicated(given)}
    wanted = {d: len(own) for d, own in runs.items() if own}
    assert len(wanted) > 20
    assert sum(min(gone[d], n) for d, n in wanted.items()) >= 0.95 * sum(wanted.values())
    assert sum(gone[d] >= n for d, n in wanted.items()) >= 0.9 * len(wanted)


def test_removed_lines_in_place_of_a_column(clashing):
    found = lines.deduplicated(clashing.withColumn("removed", F.lit("x")), removed_column="removed")
    assert found.columns.count("removed") == 1 and found.first().removed == 0


# 9


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    order = training_order.Permutation(size, 7)
    slots = order.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (order.numbers(slots) == np.arange(size)).all()
    if size >= 64:
        assert (training_order.Permutation(size, 8).slots(np.arange(size)) != slots).any()


def test_shards_hold_all_sequences(spark, docs, rows, tmp_path):
    layout = training_order.Layout(stride=16, per_shard=512)
    folder = f"file://{tmp_path}"
    found = collected(training_order.materialised(docs, folder=folder, layout=layout))
    cache = tokens.PieceCache(tokens.vocabulary())
    expected = []
    for doc_id, text, _ in rows:
        ids = cache.tokenizer.encode(text or "", add_special_tokens=False).ids
        for piece, at in enumerate(range(0, max(1, len(ids)), 16)):
            part = ids[at : at + 16]
            expected.append((doc_id, piece, len(part), packing.crc32(part)))
    same([(d, p, n, c) for d, p, _, _, _, n, c in found], expected)
    assert sorted(r[2] for r in found) == list(range(len(found)))
    assert all(s == slot // 512 and offset == slot % 512 * 32 for _, _, slot, s, offset, _, _ in found)
    by_slot = {r[2]: r[6] for r in found}
    read = training_order.read_slots(folder, 500, 1100, layout)
    assert [packing.crc32(x.tolist()) for x in read] == [by_slot[s] for s in range(500, 1100)]
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) == 32 * len(found)


# 10


def test_tokens_by_pieces_are_the_librarys(rows):
    import pyarrow as pa

    cache = tokens.PieceCache(tokens.vocabulary())
    odd = ["É́ é  İSTANBUL ΣΑΣ don't 'RE", "12½ ²³ 日本語 \U0001f600‍ x\x1cy\x85z <|endoftext|> ß ÿ! it's--", "a" * 5000]
    texts = [t for _, t, _ in rows] + odd
    # Special strings in texts have their own ids.
    assert next(cache.ids(pa.array(["stop at <|endoftext|> here"]))).tolist() == [1691, 536, 49407, 763]
    for text, ids in zip(texts, cache.ids(pa.array(texts, pa.string()))):
        assert cache.tokenizer.encode(text or "", add_special_tokens=False).ids == ids.tolist()


def test_packing(docs, rows):
    found = collected(packing.packed_documents(docs, capacity=256))
    cache = tokens.PieceCache(tokens.vocabulary())
    expected = []
    for doc_id, text, _ in rows:
        ids = cache.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            expected.append((doc_id, piece, at, len(part), packing.crc32(part)))
    same([f[:5] for f in found], expected)
    sequences = defaultdict(list)
    for *_, length, _, sequence, offset in found:
        sequences[sequence].append((offset, length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    # The bound cannot always be reached where few small pieces are left for the large ones.
    assert len(sequences) <= packing.least_bins(Counter(f[3] for f in found), 256) + 2


@pytest.mark.parametrize("seed", [15, 24, 42, 43, 52, 63])
def test_bin_completion_beats_best_fit(seed):
    """Histograms where best-fit decreasing takes a sequence too many."""
    r = random.Random(seed)
    counts = {r.randint(20, 60): r.randint(1, 6) for _ in range(r.randint(5, 9))}
    plan = packing.packed_counts(counts, 100)
    used = Counter()
    for content, number in plan:
        assert sum(content) <= 100
        used.update({x: n * number for x, n in Counter(content).items()})
    assert used == counts
    bins = sum(n for _, n in plan)
    assert bins == packing.least_bins(counts, 100) < sum(n for _, n in packing.best_fit(counts, 100))


def test_packing_of_repeated_rows_under_a_null_id(spark, monkeypatch):
    """Every slot is filled once though the rows cannot be told apart."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, id, null) AS doc_id", "0 AS piece", "0L AS start", "1 + id % 2 * 6 AS length")
    found = packing.packed(rows, 8)
    assert found.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset"]
    held = collected(found)
    assert len(held) == 3000 and len({f[-2:] for f in held}) == 3000
    assert Counter(f[3] for f in held) == {1: 1500, 7: 1500} and len({f[-2] for f in held}) == 1500


def fewest_bins(pieces, capacity):
    """Fewest bins by trying all: small cases only."""
    best = len(pieces)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] >= pieces[i]:
                place(i + 1, [*bins[:k], bins[k] - pieces[i], *bins[k + 1 :]])
        place(i + 1, [*bins, capacity - pieces[i]])

    pieces = sorted(pieces, reverse=True)
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_plan_against_all_packings(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 12, 20, 31])
    given = [r.randint(1, capacity) for _ in range(r.randint(1, 11))]
    plan = packing.packed_counts(Counter(given), capacity)
    used = Counter()
    for content, n in plan:
        assert sum(content) <= capacity
        for x in content:
            used[x] += n
    assert used == Counter(given)
    assert packing.least_bins(Counter(given), capacity) <= sum(n for _, n in plan) == fewest_bins(given, capacity)


# all


def test_empty_tables(empty, spark):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    sections = attribution.first_line_and_body(F.col("text"))
    results = [
        quality.judged(empty),
        quality.kept_documents(empty),
        simhash.near_duplicates(empty),
        simhash.one_of_each(empty),
        decontamination.contamination(empty, benchmark),
        attribution.token_counts(empty, sections),
        licenses.scanned(empty),
        lines.deduplicated(empty, count_column="n_chars"),
        training_order.materialised(empty),
        packing.packed_documents(empty),
        html_extraction.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_clashing_columns(clashing, spark):
    benchmark = spark.createDataFrame([(1, "nothing of it", 3)], "item_id bigint, text string, spans int")
    assert quality.judged(clashing).count() == 2
    assert quality.kept_documents(clashing).columns == clashing.columns
    assert simhash.near_duplicates(clashing).count() == 2
    assert simhash.one_of_each(clashing).columns == clashing.columns
    assert simhash.one_of_each(clashing).count() == 1
    assert decontamination.contamination(clashing, benchmark).count() == 2
    for pass_words in (decontamination.PASS_WORDS, 10):
        clean = decontamination.clean_documents(clashing, benchmark, pass_words=pass_words)
        assert clean.columns == clashing.columns and clean.count() == 2
    assert attribution.token_counts(clashing, attribution.first_line_and_body(F.col("text"))).count() == 6
    assert licenses.scanned(clashing).count() == 2
    deduplicated = lines.deduplicated(clashing)
    assert deduplicated.columns == clashing.columns and deduplicated.count() == 2
    assert training_order.materialised(clashing).count() == 2
    assert packing.packed_documents(clashing).count() == 2
    assert zlib.crc32(b"") == 0
