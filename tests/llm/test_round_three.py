"""Hard negatives, language identification and the manifest, against brute force and on awkward rows."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import common, decontaminate, hard_negatives, html_wrapper, lang_id, lm_score, merkle, pii, pq_dedup, sharding

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@pytest.fixture(scope="module", autouse=True)
def shared(tmp_path_factory):
    """Tables cut on the way go to a folder of the test run."""
    folder, before = str(tmp_path_factory.mktemp("cut")), common.shared_folder
    common.shared_folder = lambda spark: folder
    yield
    common.shared_folder = before


# Hard negatives

@pytest.mark.parametrize("size", [1, 200, 100_000, 2 ** 28])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    rows, anchors = rng.integers(-size, size + 1, (37, 5)), rng.integers(-size, size + 1, (11, 5))
    want = [[sum(int(x) * int(y) for x, y in zip(r, a)) for a in anchors] for r in rows]
    assert hard_negatives.packed_products(rows, anchors).tolist() == want
    assert hard_negatives.packed_products(rows * 0, anchors * 0).tolist() == np.zeros((37, 11), int).tolist()
    assert hard_negatives.packed_products(rows[:0], anchors).shape == (0, 11)


def plain_negatives(rows, positives=5, negatives=3):
    kept = []
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2 ** 62:
            kept.append((vec_id, q, label))
    out = []
    for a, qa, la in kept:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(qa, q)), b, label) for b, q, label in kept if b != a and len(q) == len(qa)]
        near = sorted((s, b) for s, b, label in scored if label == la)[:positives]
        for s, b in near:
            hard = sorted((t, c) for t, c, label in scored if label != la and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, b, k + 1, c, -s, -t) for k, (t, c) in enumerate(hard[:negatives])]
    return Counter(out)


@pytest.mark.parametrize("size,passes", [(0.4, 1), (0.4, 3), (90.0, 1), (3e6, 2)])
def test_negatives_equal_brute_force(spark, monkeypatch, size, passes):
    """Ties, copies, repeated rows, awkward vectors, and values that need the widest fields."""
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    if passes > 1:
        monkeypatch.setattr(hard_negatives, "PASS_BYTES", 1500 // passes)
    rng = random.Random(passes)
    near = [rng.gauss(0, size) for _ in range(6)]
    rows = []
    for i in range(300):
        v = [x + rng.gauss(0, size / 4) for x in near] if i % 3 else near if i % 2 else [-x for x in near]
        rows.append((i, v, i % 4))
    rows += [rows[50], rows[50], rows[51], (1000, None, 1), (1050, [], 1), (1100, [math.nan] * 6, 1), (1150, [None, 1.0], 1),
             (None, near, 1), (1200, near, None), (1250, [math.inf] * 6, 2), (1300, near[:4], 1), (1301, near[:4], 1),
             (1302, near[:4], 2), (1350, [1e300] * 6, 1), (-50, near, 3), (1400, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = hard_negatives.mine(df.withColumn("row", F.lit("x")).withColumn("rank", F.lit(1)), F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows)
    assert got.schema == hard_negatives.mine(df.where("false"), F.lit(True)).schema
    assert hard_negatives.mine(df.where("false"), F.lit(True)).count() == 0


# Language identification

def test_gradients_through_time():
    rng = np.random.default_rng(1)
    m = {k: v.astype(np.float64) for k, v in lang_id.blank(3).items()}
    codes, target = rng.integers(60, 256, (4, 9)), np.array([0, 1, 2, 1])
    codes[1, 5:] = lang_id._PAD
    _, grads = lang_id.gradients(m, codes, target)
    for name in m:
        for _ in range(8):
            at = tuple(rng.integers(0, d) for d in m[name].shape)
            if name == "table":
                at = (at[0], int(codes[0, rng.integers(0, 9)]), at[2])
            held = m[name][at]
            m[name][at] = held + 1e-4
            above = lang_id.gradients(m, codes, target)[0]
            m[name][at] = held - 1e-4
            below = lang_id.gradients(m, codes, target)[0]
            m[name][at] = held
            assert abs((above - below) / 2e-4 - grads[name][at]) < 1e-6


def test_every_letter_is_pooled_once(monkeypatch):
    """The states see both ends, windows take each position once, and the order of texts is of no account."""
    monkeypatch.setattr(lang_id, "GROUP", 3)
    m = {**lang_id.blank(2), "languages": ["a", "b"]}
    monkeypatch.setattr(lang_id, "_probabilities", lambda m, s: np.ones((2, *s.shape[::2][:2]), np.float32))
    texts = ["a" * n for n in (1, 11, 12, 24, 25, 231, 232, 233, 255, 256, 257, 488, 489, 1000, 5000)] + [None, "", "12 3"]
    sums = lang_id.document_probabilities(m, texts)
    assert (sums[:-3] == 1).all() and (sums[-3:] == 0).all()
    monkeypatch.undo()
    long = "the cat sat on the mat, " * 40
    alone = lang_id.document_probabilities(m, [long])
    among = lang_id.document_probabilities(m, ["x", long, None, long * 3])
    assert np.allclose(alone[0], among[1], atol=1e-5)


def test_languages_of_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "STEPS", 120)
    rng = random.Random(3)
    parts = {"xx": "the and ing tion er".split(), "yy": "ción que los ado es".split(), "zz": "ung der die sch ü".split()}
    rows = []
    for i in range(240):
        lang = ["xx", "xx", "yy", "zz"][i % 4]
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 90))]
        rows.append((i, " ".join(words), lang if i % 9 else None, i % 4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = lang_id.predict(docs, lang_id.learn(docs, ~held)).where(held).collect()
    true = {r[0]: ["xx", "xx", "yy", "zz"][r[0] % 4] for r in rows}
    assert len(got) > 30 and sum(r.lang_pred == true[r.doc_id] for r in got) >= 0.95 * len(got)
    assert all(0 < r.score <= 1 for r in got)


def test_languages_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "STEPS", 2)
    rows = [(1, None, "a"), (2, "", "a"), (3, " 12 \n", "b"), (None, "word", "b"), (5, "ab " * 60_000, "a"), (5, "ab", None),
            (6, "same", "a"), (6, "same", "a"), (7, "\U0001F600", "b"), (8, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("drawn", F.lit(1)).withColumn("bytes", F.lit("x"))
    got = lang_id.predict(docs, lang_id.learn(docs, F.lit(True))).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 7)) for r in got)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    nothing = lang_id.learn(docs, F.lit(False))
    assert {r.lang_pred for r in lang_id.predict(docs, nothing).collect()} == {"und"}
    assert lang_id.predict(docs.where("false"), nothing).collect() == []


# Manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, text):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def layers(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(layers, i):
        return [(i // 8 ** k % 8, layer[i // 8 ** (k + 1) * 8:][:8]) for k, layer in enumerate(layers[:-1])]

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: layers([row[2] for row in sorted(groups[x], key=lambda y: y[:3])]) for x in langs}
    top = layers([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (known, _, own, r) in enumerate(sorted(groups[lang], key=lambda y: y[:3])):
            steps = path(trees[lang], i) + path(top, k)
            folded = own
            if known and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                folded = leaf(r, r["text"].translate(str.maketrans(UPPER, UPPER.lower())))
            for at, run in steps:
                folded = digest(*run[:at], folded, *run[at + 1:])
            proof = digest(*(x for at, run in steps for j, x in enumerate(run) if j != at))
            out.append((r["doc_id"], own, trees[lang][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return Counter(out)


def manifest_of(docs):
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return merkle.manifest(docs, third, F.translate("text", UPPER, UPPER.lower()))


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_manifest_equals_brute_force(spark, monkeypatch, digits):
    """A hot group, groups of every small size, repeated rows and ids, nulls in every column, several layers of blocks."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 8 ** digits)
    rng = random.Random(digits)
    langs = ["hot"] * 700 + [x for n in range(20) for x in [f"l{n}"] * (n + 1)] + ["é", "z"] * 9 + [None] * 65 + ["", "="]
    rows = [(i if i % 40 else None, rng.choice(["a Bc", "", None, "XYZ é"]) if i % 5 else "T" * 40_000, x, rng.choice(["s", None]),
             rng.choice([1, None])) for i, x in enumerate(langs)]
    rows += [(7, "Same", "hot", "s", 1)] * 90 + [(8, "Other", "hot", "s", 1), (8, "again", "hot", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    clash = [F.lit(1).alias(c) for c in "tree rank n item digest block kids path at root leaf".split()]
    assert Counter(map(tuple, manifest_of(docs.select("*", *clash)).collect())) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(1, "One", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest_of(docs).first()
    assert got.leaf == got.subroot == got.root == digest("1:1", "1:s", "2:en", "1:3", "3:One")
    assert got.proof_sha256 == digest() and got.folded_root == got.root and got.verified
    assert manifest_of(docs.where("false")).collect() == []


# Decontamination

def test_common_phrases_write_no_passages(spark, monkeypatch):
    """Items that share an opening and texts with that phrase meet in nothing; a copy among them is found."""
    rng = random.Random(6)
    items = [(i, "Which of the following " + " ".join(f"w{rng.randrange(4000)}" for _ in range(12))) for i in range(400)]
    texts = [(i, "it asks which of the following holds " + " ".join(f"v{rng.randrange(4000)}" for _ in range(60))) for i in range(20)]
    texts[7] = (7, texts[7][1] + " " + items[3][1])
    kept, cut = [], decontaminate.cut
    monkeypatch.setattr(decontaminate, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.share) for r in found] == [(7, 3, 1.0)]
    assert kept[-1].where("item IS NOT NULL").count() == 1 and kept[-1].where("item IS NULL").count() == 20


def test_copies_near_each_other_are_rows_of_their_own(spark):
    item = " ".join(f"q{i}" for i in range(30))
    text = f"a b {item} five words between the two {item} and {item.replace('q7 ', '')} end"
    found = decontaminate.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                                spark.createDataFrame([(5, item)], "item_id long, text string")).orderBy("start").collect()
    assert [text[r.start:r.end] for r in found] == [item, item, item.replace("q7 ", "")]


def test_long_passages_are_aligned_in_windows():
    rng = np.random.default_rng(12)
    for _ in range(60):
        item, text = rng.integers(0, 5, rng.integers(2, 9)), rng.integers(0, 5, rng.integers(1, 400))
        whole, parts = decontaminate.align(item, text), decontaminate.best_alignment(item, text)
        assert whole[0] == parts[0]
    item = np.arange(100)
    text = np.full(1_000_000, -1)
    text[777_000:777_100] = item
    assert decontaminate.alignments(item, text, 30) == [(100, 777_000, 777_100)]


def test_packed_numbers_come_back():
    rng = np.random.default_rng(31)
    for kind in ("<u8", "<u4", "<i8", "u1"):
        for n in (0, 1, 777):
            x = rng.integers(0, 200, n).astype(kind)
            assert (lm_score.unpack(lm_score.pack(x), kind) == x).all()
    for kind, high in (("<u8", 2**63), ("<u4", 2**32)):
        x = np.sort(rng.integers(0, high, 500).astype(kind))
        assert (lm_score.unpack_sorted(lm_score.pack_sorted(x), kind) == x).all()
        assert len(lm_score.unpack_sorted(lm_score.pack_sorted(x[:0]), kind)) == 0


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(32)
    rows = [(i, " ".join(f"w{int(rng.random() ** 2 * 50)}" for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{r.doc_id: (r.n_known, r.base_score, r.score)
              for r in lm_score.score(docs.repartition(n), F.col("doc_id") % 7 == 2, most_bits=most).collect()}
             for n, most in ((2, None), (20, None), (20, 0))]
    assert len(found[0]) == 60 and all(f == {i: pytest.approx(x, rel=1e-12) for i, x in found[0].items()} for f in found[1:])


def test_filter_of_nine_megabytes_stays_beside_its_buckets(spark, caplog):
    """What the filter of some 5.2 million words and pairs takes (14 bits each) is not sent through the driver."""
    docs = spark.range(40).selectExpr("id + 0 AS doc_id", "array_join(transform(sequence(1, 65000), i -> hex(id * 65000 + i)), ' ') AS text")
    with caplog.at_level("INFO", logger=lm_score.__name__):
        rows = lm_score.score(docs.repartition(8), F.lit(False)).collect()
    assert len(rows) == 40 and all(r.n_tokens == 65001 for r in rows)
    assert any("kept beside their buckets" in r.getMessage() for r in caplog.records)


def test_wide_levels_are_matched_in_little_memory(monkeypatch):
    rng = np.random.default_rng(33)
    for _ in range(100):
        x, y = (rng.integers(0, 4, rng.integers(0, 30)) for _ in range(2))
        monkeypatch.setattr(html_wrapper, "CELLS", 1 << 22)
        whole = html_wrapper._common(x, y)
        monkeypatch.setattr(html_wrapper, "CELLS", 20)
        found = html_wrapper._common(x, y)
        assert len(found) == len(whole) and all(x[i] == y[j] for i, j in found)
        assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))


def test_alignment_finds_the_article_without_names(spark):
    """Pages whose elements and names tell nothing: every section is a div, every name a letter."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = F.regexp_replace("html", "<(/?)(article|main|nav|aside|header|footer|section|form)\\b", "<$1div")
    bare = F.regexp_replace(bare, "(class|id|role)=[\"'][^\"']*[\"']", 'class="k"')
    lone = F.concat(F.lit("https://h"), F.col("page_id").cast("string"), F.lit(".example/"))
    text = lambda df: {r.page_id: r.text for r in html_wrapper.extract(df).collect()}
    want, got = text(pages), text(pages.withColumn("html", bare))
    alone = text(pages.withColumn("html", bare).withColumn("url", lone))
    share = lambda found, ids: sum(found[i] == want[i] for i in ids) / len(ids)
    assert share(got, want) > share(alone, want) + 0.05
    # With a few pages to align, all of a host's.
    host = {r.page_id: r.url.split("/")[2] for r in pages.collect()}
    many = [i for i in want if Counter(host.values())[host[i]] >= 6]
    assert len(many) > 100 and share(got, many) > 0.98 > 0.9 > share(alone, many)


@pytest.mark.parametrize("rows_a_list, block", [(8, 7), (8, 1000), (60, 15)])
def test_links_between_lists_are_counted_at_both_ends(spark, monkeypatch, rows_a_list, block):
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", rows_a_list)
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    rng = np.random.default_rng(34)
    base = rng.normal(size=(25, 8))
    x = (base[rng.integers(0, 25, 220)] + 0.06 * rng.normal(size=(220, 8))).astype(np.float32)
    x[200:] = x[3]
    label = [int(v) for v in rng.integers(0, 2, 220)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(220, dtype=bool)
    got = {r.vec_id: r.n_links for r in pq_dedup.link(spark.createDataFrame(
        [(i, v.tolist(), label[i]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    assert [got[i] for i in range(220)] == linked.sum(1).tolist()


def test_shards_by_recomputation(spark):
    """Many strata of one row, which all lie at one half, beside one stratum with most rows."""
    rng = random.Random(35)
    rows = [(i, "x" * rng.randrange(5), f"one{i}" if i % 3 else "hot") for i in range(400)] + [(7, "", "hot")] * 2 + [(8, None, None)]
    fields = []
    for i, text, source in rows:
        crc = zlib.crc32((text or "").encode())
        drawn = int(hashlib.md5(f"20240201|{i}|{crc}".encode()).hexdigest()[:15], 16)
        fields.append(("" if source is None else "=" + source, drawn, i, len(text or "") + 1, crc))
    of = defaultdict(list)
    for f in sorted(fields):
        of[f[0]].append(f)
    laid = sorted(((k + 0.5) / len(v), *f) for v in of.values() for k, f in enumerate(v))
    want = Counter((f[3], f[4], f[5], at * 8 // len(laid)) for at, f in enumerate(laid))
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def _windows_of_texts(n=512):
    codes = np.random.default_rng(2).integers(32, 127, (n, pii.WINDOW))
    return codes, pii.fit(codes[:64], np.zeros((64, pii.WINDOW), np.int64), epochs=1)


def test_windows_are_read_in_little_memory():
    """States that only the way back needs are not held (about 77 MB a task before)."""
    codes, model = _windows_of_texts()
    kept = pii._emissions(model, codes, keep=True)[0]
    tracemalloc.start()
    try:
        read = pii._emissions(model, codes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(read, kept)
    assert peak < 32 << 20


def test_texts_are_masked_a_few_at_a_time(spark, monkeypatch):
    """Whatever the batches, a task holds TOGETHER texts as objects, and rows keep their order and columns."""
    _, model = _windows_of_texts(64)
    monkeypatch.setattr(pii, "TOGETHER", 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": [5, 1, 3, 2, 4], "text": ["a@b.cd", None, "", "x", "10.0.0.1 y"]})
    assert [b.num_rows for b in pii._few(iter([batch]))] == [2, 2, 1]
    docs = spark.createDataFrame(batch.to_pylist(), "doc_id long, text string").coalesce(1)
    rows = [(r["doc_id"], r["text"]) for r in pii.mask(docs, model).collect()]
    assert sorted(rows) == [(1, None), (2, "x"), (3, ""), (4, "<IP> y"), (5, "<EMAIL>")]
