"""Training-data operators against brute force, and on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import (
    common, decontaminate, html_wrapper, jaccard_join, lm_score, packing, pii, pq_dedup, pu_quality, sharding, substring_dedup,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sig tau ups".split()


@pytest.fixture(scope="module", autouse=True)
def shared(tmp_path_factory):
    """Tables cut on the way go to a folder of the test run."""
    folder, before = str(tmp_path_factory.mktemp("cut")), common.shared_folder
    common.shared_folder = lambda spark: folder
    yield
    common.shared_folder = before


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3, "doc_id")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) + "."


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, columns of clashing names."""
    long = "word " * 20_000 + "7" * 3_000 + " " + "x" * 30_000 + "@" + "y" * 2_000
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "some text here for you", "a"), (None, None, None), (4, long, "a"), (5, "one", "b"),
            (5, "one", "b"), (6, "Same text, said twice over.", "a"), (7, "Same text, said twice over.", "a"), (8, "\U0001F600 é ÄÖ <b> \x00 \x1c end", "c")]
    df = docs_of(spark, rows)
    clash = ("score rank component component_id label node shard slot bucket row held_out removed place version first worker bin fit point signatures "
             "features drawn unit host wrapper quality n_chars lang").split()
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in clash]), len(rows)


def quality_of(docs, labels):
    return pu_quality.score(docs, pu_quality.learn(docs, labels, F.lit(True)))


def operators(spark):
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "Same text, said twice over."), (2, None), (3, ""), (None, "!?"), (4, "one")], "item_id long, text string")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return {
        "quality": (lambda d: quality_of(d, labels), 1), "dedup": (substring_dedup.dedup, 1), "join": (jaccard_join.join, 1),
        "pii": (lambda d: pii.detect(d, pii.learn(d)), 1), "mask": (lambda d: pii.mask(d, pii.fit(np.zeros((2, pii.WINDOW), int), np.zeros((2, pii.WINDOW), int))), 1),
        "shards": (sharding.interleave, 1), "pack": (lambda d: packing.pack(d, TOKENIZER), None), "leaks": (lambda d: decontaminate.leaks(d, items), None),
        "lm": (lambda d: lm_score.score(d, fold), 1),
    }


@pytest.mark.parametrize("name", ["quality", "dedup", "join", "pii", "mask", "shards", "pack", "leaks", "lm"])
def test_awkward_rows_and_empty_tables(spark, monkeypatch, name):
    monkeypatch.setattr(pii, "EPOCHS", 1)
    monkeypatch.setattr(pii, "MADE", 200)
    docs, n = awkward(spark)
    run, each = operators(spark)[name]
    got = run(docs).collect()
    assert each is None or len(got) == n
    assert run(docs.where("false")).collect() == []
    if name == "join":
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id}
        assert found[7] == (1, 6) and found[5] == (1, 5) and found[2] == (0, 2) and found[3] == (0, 3)
    if name == "pack":
        assert {r.doc_id for r in got} >= {1, 2, 3, None} and sum(r.doc_id == 5 for r in got) == 2
        assert [r.length for r in got if r.doc_id in (1, 2)] == [1, 1]
    if name == "leaks":
        assert {(r.doc_id, r.item_id) for r in got} == {(6, 1), (7, 1), (5, 4)}
    if name == "shards":
        assert sorted(Counter(r.shard for r in got).values()) == [1, 1, 1, 1, 1, 2, 2, 2]
        assert all(r["size"] == 1 and r.text_crc32 == 0 for r in got if r.doc_id in (1, 2))
    if name == "dedup":
        assert next(r.text for r in got if r.doc_id == 1) is None and next(r.text for r in got if r.doc_id == 2) == ""
    if name == "lm":
        assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3))


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 7), (9, 7), (20, 20), (11, 30), (30, 12), (12, 31), (31, 10)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 10: 10, 11: 10, 12: 10, 30: 10, 31: 10}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = []
    for i in range(700):
        bad = rng.random() < 0.2
        text = " ".join(rng.choice(WORDS) + ("***" if bad else "") for _ in range(rng.randint(20, 80)))
        rows.append((i, text, "s", 0 if bad else 1))
    docs = docs_of(spark, [r[:3] for r in rows])
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2], "doc_id long, quality int")
    model = pu_quality.learn(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    assert abs(model["prior"] - 0.8) < 0.1
    got = {r.doc_id: r.score for r in pu_quality.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, _, _, q in held]) > 0.97


def test_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    shared = [" ".join(sentence(rng, rng.randint(1, 14)) for _ in range(5)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else sentence(rng, rng.randint(2, 12)) for _ in range(rng.randint(1, 6))]
        rows.append((i, rng.choice([" ", "\n"]).join(parts), "s"))
    first = {}
    for i, text, _ in rows:
        for place, (_, _, words) in enumerate(substring_dedup.units(text)):
            first.setdefault(" ".join(words).lower(), (i, place))
    for r in substring_dedup.dedup(docs_of(spark, rows)).collect():
        text, want, run = rows[r.doc_id][1], [], []
        for place, (a, b, words) in [*enumerate(substring_dedup.units(text)), (-1, (0, 0, ["\x00"]))]:
            if first.get(" ".join(words).lower(), (r.doc_id, place)) != (r.doc_id, place):
                run.append((a, b, len(words)))
                continue
            if sum(n for *_, n in run) >= substring_dedup.LEAST:
                want.append((run[0][0], run[-1][1]))
            run = []
        assert [(s.start, s.end) for s in r.removed] == want
        assert r.text == substring_dedup.without(text, want)


def near_copies(rng, groups, size, edit):
    rows = []
    for _ in range(groups):
        base = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.choice([3, 6, 7, 12, 40, 150]))]
        for _ in range(rng.randint(1, size)):
            rows.append([w if rng.random() > edit else rng.choice(WORDS) for w in base])
    rng.shuffle(rows)
    return [(i * 3 + 1, " ".join(w).upper() if i % 4 == 0 else "\n".join(w), "s") for i, w in enumerate(rows)]


@pytest.mark.parametrize("width, percent, edit", [(4, 85, 0.01), (5, 80, 0.03), (2, 60, 0.05)])
def test_join_equals_brute_force(spark, monkeypatch, width, percent, edit):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = near_copies(random.Random(width), 30, 12, edit)

    def shingle(text):
        w = text.lower().split()
        return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}

    sets = {i: shingle(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs_of(spark, rows), width, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(4)
    points = rng.poisson(rng.choice([0.3, 2, 9], 300)[:, None], (300, jaccard_join.GROUPS))
    tree = jaccard_join.Tree(points)
    for q in points[:40]:
        want = {i for i, p in enumerate(points) if np.minimum(p, q).sum() >= jaccard_join.overlap(q.sum(), p.sum(), 80)}
        assert set(tree.search(q, 80).tolist()) == want


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return pii.ordered(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@..--__+ 0123450()é\n") for _ in range(rng.randrange(50)))
        assert pii.base_spans(text) == brute_pii(text)
    assert pii.base_spans("é 0255.1.1.001 256.1.1.1 1.2.3.4.5") == [("ip", 2, 14), ("ip", 25, 32)]


def test_tagger_learns_spans_and_windows_agree():
    made = pii.made_up(1_300, seed=9)
    codes = np.stack([pii._cut_out(pii._codes(t), 0) for t, _ in made])
    tags = np.stack([pii._tags(s, 0) for _, s in made])
    model = pii.fit(codes[:1_100], tags[:1_100], epochs=6)
    got, _ = pii.decode(model, codes[1_100:])
    assert (got == tags[1_100:]).mean() > 0.97
    text = "plain words only " * 30 + "call (555) 010-7788 now or write me (at) home.example.org " + "more plain words " * 30
    spans = pii.find([text, None, ""], model)
    assert spans[1] == spans[2] == ([], []) and all(s in spans[0][1] for s in spans[0][0])
    # The gradient of the likelihood agrees with a finite difference.
    small = {k: v.astype(np.float64) for k, v in model.items()}

    def loss(m):
        e = pii._emissions(m, codes[:3])
        z, _, _ = pii._marginals(e, m["trans"])
        gold = tags[:3].T
        path = np.take_along_axis(e, gold[:, :, None], 2).sum() + m["trans"][gold[:-1], gold[1:]].sum()
        return z.sum() - path

    e, x, both, kept_f, _ = pii._emissions(small, codes[:3], keep=True)
    _, marginal, _ = pii._marginals(e, small["trans"])
    np.put_along_axis(marginal, tags[:3].T[:, :, None], np.take_along_axis(marginal, tags[:3].T[:, :, None], 2) - 1, 2)
    _, dw, _, _ = pii._lstm_back(x, small["wf"], small["uf"], kept_f, (marginal @ small["v"].T)[:, :, :pii.HIDDEN])
    for at in ((0, 0), (3, 20), (7, 50)):
        up, down = ({k: v.copy() for k, v in small.items()} for _ in range(2))
        up["wf"][at] += 1e-5
        down["wf"][at] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, dw[at], rel_tol=1e-3, abs_tol=1e-5)


def test_masking():
    text = "mail a.b@c.org or +1 (375) 555-4393, 1.2.3.4"
    assert pii.masked(text, pii.base_spans(text)) == "mail <EMAIL> or <PHONE>, <IP>"


def test_shards_hold_the_mixture(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 5), "hot" if i % 3 == 0 else f"s{rng.randrange(5)}") for i in range(500)] + [(i, "x", None) for i in range(500, 510)]
    got = sharding.interleave(docs_of(spark, rows), shards=8).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    source = {i: s for i, _, s in rows}
    counts, totals = Counter((source[r.doc_id], r.shard) for r in got), Counter(source.values())
    assert all(abs(counts[s, k] - n / 8) < 1.5 for s, n in totals.items() for k in range(8))
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs_of(spark, rows[::-1]), shards=8).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_units_encode_like_whole_texts():
    rng = random.Random(8)
    encoder = packing.Encoder(TOKENIZER)
    alphabet = list("ab 's\n\t\r é1!<|\xa0\x85　\x1c中ll.,,;ª²")
    for k in range(3_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        packing_cached = k < 1_500
        encoder.known = encoder.known if packing_cached else {}
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 40, 300, 2_500]))), "s") for i in range(120)]
    got = packing.pack(docs_of(spark, rows), TOKENIZER).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    encoder = packing.Encoder(TOKENIZER)
    for i, text, _ in rows:
        ids, at = encoder.encode(text) + (1).to_bytes(4, "little"), 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + r.length)]) and r.doc_tokens == len(ids) // 4
            at += r.length
        assert 4 * at == len(ids)
    for n in range(1, 5_000):
        cut = list(packing.pieces(n, 2048))
        assert sum(a for a, _ in cut) == n and all(a * k <= 2048 for a, k in cut)


def test_leaks_edited_and_clean(spark, monkeypatch):
    rng = random.Random(10)
    items = {k: [rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(rng.randint(15, 50))] for k in range(30)}
    rows, want = [], set()
    for i in range(150):
        words = [rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(rng.randint(20, 200))]
        if i % 3 == 0:
            k = rng.randrange(30)
            copy = [w if rng.random() > 0.15 else "other" for w in items[k]] if i % 2 else items[k]
            at = rng.randrange(len(words))
            words[at:at] = copy
            want.add((i, k))
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words), "s"))
    tests = spark.createDataFrame([(k, " ".join(w).capitalize() + ".") for k, w in items.items()], "item_id long, text string")
    docs = docs_of(spark, rows)
    found = decontaminate.leaks(docs, tests).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    whole = next(r for r in found if r.doc_id == 0)
    assert decontaminate.words(rows[0][1][whole.start:whole.end]) == [w.lower() for w in items[whole.item_id]] and whole.share == 1.0
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, tests).collect()} == want


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(11)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, start, end = decontaminate.align(a, b)
        assert score == h.max() and (score == 0 or 0 <= start < end <= len(b))


PAGE = ('<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">{nav}</a></ul></nav>'
        '<div class="ad">{ad}</div><div id="wrap"><div class="body"><h1>{head}</h1><p>{one} &amp; <b>bo</b>ld<br>next<p>{two}</div><div class="comments"><p>nice</p></div></div>'
        "<p>All rights reserved by us</p><footer>&copy; {foot}</footer></body></html>")


def test_main_text_of_pages(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(24):
        f = {k: sentence(rng, n) for k, n in (("nav", 2), ("ad", 4), ("head", 3), ("one", 30), ("two", 25), ("foot", 3))}
        rows.append((i, f"http://www.site.example/{i}" if i % 2 else f"HTTP://WWW.site.example:80/{i}?q", PAGE.format(**f)))
        want[i] = f"{f['head']} {f['one']} & bold next {f['two']}"
    rows += [(100, None, None), (101, "x", ""), (102, "http://lone.example", "<p>only <i>te</i>xt &lt;b&gt;</p>"), (103, "http://lone2.example/", "<article><p>cut off &am"), (102, "http://lone.example", "<p>only <i>te</i>xt &lt;b&gt;</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "wrapper", "drawn", "text")})
    got = {r.page_id: r for r in html_wrapper.extract(pages).collect()}
    assert all(got[i].text == t for i, t in want.items())
    assert (got[100].text, got[101].text, got[102].text, got[103].text) == ("", "", "only text <b>", "cut off &am")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_wrapper.extract(pages.where("false")).count() == 0
    deep = html_wrapper.main_text("<div>" * 20_000 + "down here")
    assert deep == "down here"


def test_lm_scores(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))), "s") for i in range(120)]
    tokens = lambda t: t.lower().split() + ["\x00end"]
    train = [tokens(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    for heavy in (1 << 20, 4):
        monkeypatch.setattr(lm_score, "HEAVY", heavy)
        got = {r.doc_id: r for r in lm_score.score(docs_of(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
        for i, t, _ in rows:
            base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))
            assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].train_tokens == n
            assert (got[i].n_tokens, got[i].n_known) == (len(tokens(t)), sum(count[w] > 0 for w in tokens(t)))
            assert got[i].score <= 0


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(14)
    keys = np.unique(rng.integers(0, 2**63, 3_000).astype(np.uint64))
    counts = rng.integers(2, 500, len(keys))
    bits, levels = 8 * 50_000, lm_score.level(counts)
    segment = np.zeros(bits, np.uint8)
    for j in range(1, levels.max() + 1):
        for place in lm_score._places(lm_score._word_keys(keys[levels >= j]), j, bits):
            segment[place.astype(np.int64)] = 1
    probe = lm_score.Filter(np.packbits(segment, bitorder="little"), bits, 0, 1)
    found = probe.levels(lm_score._word_keys(keys), np.zeros(len(keys), np.uint64))
    assert (found >= levels).all() and (found == levels).mean() > 0.95
    other = rng.integers(0, 2**63, 3_000).astype(np.uint64)
    assert (probe.levels(lm_score._word_keys(other), np.zeros(len(other), np.uint64)) > 0).mean() < 0.05
    assert lm_score.level(np.array([0, 1, 2, 3, 4, 7, 8, 1024])).tolist() == [0, 0, 1, 1, 2, 2, 3, 10]


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK", 20)
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", 40)
    rng = np.random.default_rng(15)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(300):
        x = base[rng.integers(60)] * rng.uniform(0.1, 9) + rng.choice([0, 0.02, 0.12, 2]) * rng.normal(size=16)
        rows.append((i, x.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(300 + i, base[0].astype(np.float32).tolist(), 1) for i in range(30)]
    unit = {i: np.array(x, float) / np.linalg.norm(np.array(x, float)) for i, x, _ in rows}
    label = {i: lab for i, _, lab in rows}
    links = {i: {j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.98} for i in unit}
    root, seen = {}, set()
    for i in sorted(unit):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                root[x] = i
                todo += links[x]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [None] + [1.0] * 15, 1),
           (906, rows[0][1], None), (907, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("class", "unit", "print", "row")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.link(frame).collect()}
    assert {i: got[i] for i in unit} == {i: (len(links[i]), root[i], root[i] == i) for i in unit}
    assert all(got[i] == (0, i, True) for i, *_ in odd)
    assert pq_dedup.link(frame.where("false")).count() == 0


def test_repeated_lines_go_whatever_their_length(spark):
    bar = "Share this. Print"
    rows = [(i, f"{sentence(random.Random(i), 12)}\n{bar}\n{sentence(random.Random(50 + i), 12)} Go on then now friend.", "s") for i in range(4)]
    rows += [(10, "A short text", "s"), (11, "a  short TEXT", "s"), (12, "Five words are here now. Two more\n\nFive words are here now. Two more", "s")]
    got = {r.doc_id: r for r in substring_dedup.dedup(docs_of(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and [s.asDict() for s in got[0].removed] == []
    for i in range(1, 4):
        assert got[i].text == rows[i][1].replace(bar + "\n", "") and got[i].n_removed == len(bar)
    assert got[10].text == "A short text" and got[11].text == "" and got[11].n_removed == len(rows[5][1])
    assert got[12].text == "Five words are here now. Two more\n\n"


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(16)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 1) for i in range(80)]
    rows += [(100 + i, rows[i][1][:15] + [rows[i][1][15] + 0.01], 1) for i in range(5)]
    # Two groups of a shorter length, and one stray vector longer than all.
    rows += [(200 + i, [1.0, 2.0, 3.0 + 0.01 * i], 1) for i in range(3)] + [(210 + i, [-1.0, 2.0, 0.01 * i], 2) for i in range(2)]
    rows += [(300, [1.0] * 40, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[i] == got[100 + i] == (1, i) for i in range(5))
    assert [got[200 + i] for i in range(3)] == [(2, 200)] * 3 and [got[210 + i] for i in range(2)] == [(1, 210)] * 2
    assert got[300] == (0, 300) and got[50] == (0, 50)


@pytest.mark.parametrize("size", [60, 110, 300])
def test_long_spans_are_found_wherever_they_stand(monkeypatch, size):
    """With a tagger that takes every run of marks for an e-mail."""
    marks = [ord(c) for c in "x.(at)"]

    def decode(model, codes):
        own = np.isin(codes, marks)
        return np.where(own, np.where(np.c_[np.zeros(len(own), bool), own[:, :-1]], 2, 1), 0), np.ones(codes.shape)

    monkeypatch.setattr(pii, "decode", decode)
    half = (size - 4) // 2
    span = "x" * half + "(at)" + "x" * (size - 8 - half) + ".xxx"
    for offset in range(64):
        text = "y " * 400 + "y" * offset + " " + span + " " + "y " * 400
        assert pii.find([text], {})[0] == ([], [("email", 801 + offset, 801 + offset + size)])


def test_at_spelt_without_brackets_is_looked_at():
    assert all(pii.windows(t) for t in ("me at home.example.org", "me {AT} home.example.org", "me(At)home.example.org")) and not pii.windows("that attic flat")


def test_branches_after_many_siblings():
    rng = random.Random(21)

    def page(n, more=""):
        flat = "".join(f"<div>{sentence(rng, 2)}</div>" for _ in range(n))
        body = "".join(f"<p>{sentence(rng, 20)}</p>" for _ in range(30))
        return f"<body>{flat}<div><div>{body}</div><div>by us</div></div>{more}</body>", " ".join(re.findall("<p>(.*?)</p>", body))

    wrapper = html_wrapper.induce([page(60)[0] for _ in range(8)])
    for n in (60, 58, 64):
        text, want = page(n)
        assert html_wrapper.main_text(text, wrapper) == want
    text, want = page(60, "<div>end</div>")
    assert html_wrapper.main_text(text, wrapper) == want


def test_matching_equals_the_plain_recurrence():
    rng = random.Random(22)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        got = html_wrapper.match(a, [html_wrapper.Node("x", k, False) for k in b])
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + (a[i] == b[j]))
        places = [p for p in got if p is not None]
        assert len(places) == best[0][0] and places == sorted(set(places)) and all(p is None or a[i] == b[p] for i, p in enumerate(got))


@pytest.mark.parametrize("outer, inner", [
    ("div class='content-sidebar-wrap'", "article"), ("div class='has-sidebar'", "div class='post'"), ("div class='no-sidebar page'", "main"),
    ("div id='search-content'", "div"), ("div class='post has-comments'", "div class='entry'")])
def test_names_leave_out_only_what_does_not_hold_the_article(outer, inner):
    rng = random.Random(23)

    def page():
        body = "".join(f"<p>{sentence(rng, 20)}</p>" for _ in range(4))
        return (f"<body><div class='menu'>home about</div><{outer}><{inner}>{body}</{inner.split()[0]}><div class='sidebar'>{sentence(rng, 6)}</div>"
                f"<div class='related'><article>{sentence(rng, 3)}</article></div></div><div class='comments'><p>{sentence(rng, 5)}</p></div></body>"), " ".join(re.findall("<p>(.*?)</p>", body))

    wrapper = html_wrapper.induce([page()[0] for _ in range(8)])
    for w in (wrapper, None):
        text, want = page()
        assert html_wrapper.main_text(text, w) == want


def test_long_comments_stay_out():
    rng = random.Random(24)
    pages = [f"<body><div class='post'><p>{sentence(rng, 20)}</p></div><div class='comments-area'>{sentence(rng, 60)}</div></body>" for _ in range(9)]
    wrapper = html_wrapper.induce(pages[:8])
    assert html_wrapper.main_text(pages[8], wrapper) == html_wrapper.main_text(pages[8]) == re.findall("<p>(.*?)</p>", pages[8])[0]


def test_pair_scores_equal_a_plain_model(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice(WORDS) + str(int(rng.random() ** 3 * 9)) for _ in range(rng.randint(0, 60))), "s") for i in range(150)]
    tokens = lambda t: t.lower().split() + ["\x00end"]
    train = [tokens(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count, both = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["\x00end", *t], t))
    n, v, weight = sum(count.values()), len(count), lm_score.WEIGHT
    middle = lambda c: c if c < 2 else 2.0 ** (math.floor(math.log2(c)) + 0.5)
    for heavy in (1 << 20, 4):
        word = lambda w: count[w] if count[w] >= n / heavy else middle(count[w])
        monkeypatch.setattr(lm_score, "HEAVY", heavy)
        monkeypatch.setattr(lm_score, "CHUNK", 700)
        got = {}
        for most in (1 << 29, 0):
            monkeypatch.setattr(lm_score, "MAX_BITS", most)
            got[most] = {r.doc_id: r for r in lm_score.score(docs_of(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
        right = 0
        for i, t, _ in rows:
            want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))
            for a, w in zip(["\x00end", *tokens(t)], tokens(t)):
                seen = min(middle(both[a, w]), word(a), word(w))
                want += math.log10(1 - weight + (weight * seen / word(a) / ((word(w) + 1) / (n + v + 1)) if seen else 0))
            assert math.isclose(got[0][i].score, got[1 << 29][i].score, rel_tol=1e-12) and got[0][i].base_score == pytest.approx(got[1 << 29][i].base_score)
            assert abs(got[0][i].score - want) < 2
            right += math.isclose(got[0][i].score, want, rel_tol=1e-9)
        # The others hold a false positive of the filter.
        assert right > 0.8 * len(rows)
