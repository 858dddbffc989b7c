"""Each operator on small tables against its plain version, with the rows that break things."""

import base64
import hashlib
import os
import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from courtside.llm import (
    decontaminate, exact_dedup, language, mixing, near_dedup, secrets, substring_dedup, toxicity, url_rules, warc,
)
from courtside.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.llm import brute
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = [a + b for a in "ba du ki lo me nu po ra si to".split() for b in "da ge hi jo ku la mo".split()]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, source): null, empty, long, copied, edited and shared texts; ids are not in order."""
    base, shared = prose(1, 300), prose(2, 70)
    edit = lambda seed, k: " ".join(w if random.Random(f"{seed}{i}").random() > k else "neu" + str(i) for i, w in enumerate(base.split()))
    rows = [(9, base, "a"), (4, base, "a"), (7, base.replace(" ", "\n"), None), (12, base.upper(), "a"), (30, None, "b"), (31, "", "b"),
            (32, " \t ", "b"), (33, "one two", "b"), (2, "one two", "b"), (40, prose(3, 20_000), "c"), (50, "é 中文 " + shared + " end", "c"),
            (3, "start " + shared, "c"), (51, shared, None), (-5, "x " + shared + " y", "c")]
    rows += [(100 + i, edit(i, i / 100), "a") for i in range(12)] + [(200 + i, prose(10 + i, 40), "d") for i in range(20)]
    return rows


@pytest.fixture
def docs(spark, corpus):
    frame = spark.createDataFrame(corpus, "doc_id long, text string, source string")
    return frame.withColumns({c: F.lit("clash") for c in ("h", "n", "words", "kept", "place", "size")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def by_id(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}


def test_decontaminate(spark, docs, corpus, empty):
    items = [(1, prose(2, 70)), (2, prose(1, 300)[100:400]), (3, "One, TWO!"), (4, ""), (5, None), (6, "nowhere to be found"), (1, prose(2, 70))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminated([r[:2] for r in corpus], items)
    found = decontaminate.find_hits(docs, bench)
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in found.collect()}
    assert got == {d: w[:3] for d, w in want.items()}
    # windows searched block by block are the same windows
    some = docs.where("doc_id in (3, 33, 50, 110)")
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in decontaminate.find_hits(some, bench, block_rows=200).collect()}
    assert got == {d: want[d][:3] for d in got} and len(got) == 4
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {d for d, w in want.items() if not w[4]}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[50] == "é 中文 end" and cut[30] is None and cut[200] == dict((r[0], r[1]) for r in corpus)[200]
    assert decontaminate.find_hits(empty, bench).count() == 0
    assert decontaminate.find_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://org", "https://a.org/x", "http://www.example.org/es/1", "http://example.org/en/12?q", "http://xexample.org/es/",
            "HTTP://EXAMPLE.COM/fr/", "http://a.com/de/#f", "http://com/fr", "x://a.b.com/fr/a?b/de/", "http://example.org.", "http://org:80/", "://", "http:///p"]
    pages = list(enumerate(urls * 2))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    rules = spark.createDataFrame([*URL_RULES, ("example.org", "/e", "allow")], "host string, path string, action string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(frame, rules).collect()), key=repr)
    assert got == brute.judged(pages, [*URL_RULES, ("example.org", "/e", "allow")])
    assert url_rules.judge(frame.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(frame, rules.limit(0)).collect()} == {"allow"}


def test_secrets(spark, empty):
    key, weak = "AKIA" + "ABCDEFGH23456789", "aB3dE5gH7jK9mN1pQ3rS5tU7"
    texts = [None, "", f"id {key} then {weak} at https://s.example/x", f"{weak} alone", f"api_key='abc123def' user_id: bob {'ab' * 12}",
             "secret=token:abcdefg Token = 12345 PASSWORD: \"long-enough\"", "é中😀 " + key + " " * 500 + weak, f"https://a.example {key} secret=abcdefgh"]
    rows = list(enumerate(texts))
    found = {r.doc_id: [(s.start, s.number, s.end) for s in r.spans] for r in
             secrets.find_secrets(spark.createDataFrame(rows + rows[2:3], "doc_id long, text string")).collect()}
    assert found == {d: brute.secret_spans(t or "") for d, t in rows}
    assert any(s[1] == 3 for s in found[2]) and not found[3]
    hidden = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert key not in hidden[2] and weak not in hidden[2] and hidden[3] == texts[3]
    assert secrets.find_secrets(empty).count() == 0


def test_secret_scope_is_the_gap_between_spans(spark):
    access, weak = "AKIA" + "ABCDEFGH23456789", "aB3dE5gH7jK9mN1pQ3rS5tU7" * 10
    texts = [f"{weak} {access}", f"{access} {weak}", f"{weak}{' ' * 200}{access}", f"{weak}{' ' * 201}{access}", f"{access}{' ' * 201}{weak}", weak]
    found = {r.doc_id: {(s.kind, s.linked) for s in r.spans} for r in
             secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    both = {("access", True), ("key", True)}
    assert found == {0: both, 1: both, 2: both, 3: {("access", False)}, 4: {("access", False)}, 5: set()}


def test_complementary_weak_parts_are_all_reported(spark):
    access, weak, where = "AKIA" + "ABCDEFGH23456789", "aB3dE5gH7jK9mN1pQ3rS5tU7", "https://s.example/x"
    texts = [f"{access} {weak} {where}", f"user_id: bob {weak}", f"user_id: bob {where}", f"{weak} {where}", f"user_id: bob {weak} {where}"]
    got = {r.doc_id: {s.kind for s in r.spans} for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: {"access", "key", "endpoint"}, 1: {"account", "key"}, 2: set(), 3: set(), 4: {"account", "key", "endpoint"}}
    assert all({k for _, k, _ in brute.secret_spans(t)} == {[x[0] for x in secrets.KINDS].index(k) for k in got[i]} for i, t in enumerate(texts))


def test_secrets_of_rows_without_or_with_one_id(spark):
    key = "AKIA" + "ABCDEFGH23456789"
    texts = ["nothing here at all", f"id {key}", "token = abc AKIA12 then", None, "", "😀 é " + key + " end"]
    for ids in ([None] * 6, [7] * 6):
        frame = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)] * 2, "doc_id long, text string, spans string").withColumns(
            {c: F.lit(0) for c in ("kind", "start", "end", "value", "text_key", "part", "holds")})
        found = secrets.find_secrets(frame).collect()
        assert sorted(len(r.spans) for r in found) == [0, 0, 0, 1, 1]  # null is as empty
        hidden = secrets.redact(frame)
        assert hidden.columns == frame.columns
        want = [t if t is None else t.replace(key, "[redacted]") for t in texts] * 2
        assert sorted(map(str, want)) == sorted(str(r.text) for r in hidden.collect())


def test_secrets_in_a_very_long_text(spark):
    text = ("0123456789abcdef0123456789 é. " * 170_000)  # 5 MB of hexadecimal runs
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = secrets.find_secrets(frame).select(F.size("spans").alias("n"), F.element_at("spans", -1)["start"].alias("last")).first()
    assert (row.n, row.last) == (170_000, 30 * 169_999) and time.time() - start < 120
    text = secrets.redact(frame, mask="it's").first().text
    assert text == "it's é. " * 170_000 and time.time() - start < 240


def test_a_host_of_very_many_labels(spark):
    url = "http://" + "a." * 8000 + "example.org/es/1"
    frame = spark.createDataFrame([(1, url, "clash"), (2, "http://org", "")], "page_id long, url string, host string").withColumns({c: F.lit(1) for c in ("path", "rule", "key", "kind", "level")})
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    start = time.time()
    got = {r.page_id: (len(r.host), r.rule, r.verdict) for r in url_rules.judge(frame, rules).collect()}
    assert got == {1: (16_011, "example.org/es/", "block"), 2: (3, None, "allow")} and time.time() - start < 60


def test_texts_of_one_id_are_decontaminated_apart(spark):
    leak, clean, other = prose(2, 30), prose(3, 30), prose(4, 30)
    rows = [(8, leak), (8, clean), (8, clean), (None, leak), (None, other), (9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item_id", "items", "spans", "text_key")})
    bench = spark.createDataFrame([(1, prose(2, 30), "clash"), (None, clean, "")], "item_id long, text string, doc_id string")
    left = decontaminate.decontaminate(frame, bench)
    assert left.columns == frame.columns and sorted(map(str, (r.text for r in left.collect()))) == sorted(map(str, [clean, clean, other, None]))
    cut = decontaminate.decontaminate(frame, bench, remove="spans")
    assert sorted(map(str, (r.text for r in cut.collect()))) == sorted(map(str, ["", clean, clean, "", other, None]))


def test_mixing_rows_without_or_with_one_id(spark):
    rows = [(None if i % 2 else i % 7, prose(i % 90, 5 + i % 60), "ab"[i % 3 == 0]) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("size", "target", "draw", "bucket", "text_key")})
    plans = [mixing.mix(f, mixing.ranked_weights(f)).select("doc_id", "text_key", "source", "repeats", "taken").collect()
             for f in (frame.repartition(2), frame.repartition(7, "text"))]
    assert len(plans[0]) == 600 and sorted(map(str, plans[0])) == sorted(map(str, plans[1]))
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    taken = stage(spark, frame, FOLDER)
    assert taken.columns == [*frame.columns, "copy"]
    words = {r.source: r.n for r in taken.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    planned = {s: sum(r.taken for r in plans[0] if r.source == s) for s in "ab"}
    assert words == planned
    aims = {r.source: r.target for r in mixing.mix(frame, mixing.ranked_weights(frame)).select("source", "target").distinct().collect()}
    assert all(abs(words[s] - aims[s]) <= 65 for s in "ab")
    assert stage(spark, frame.limit(0), FOLDER).count() == 0


def test_a_stray_in_a_bucket_of_copies_costs_a_row_per_copy(spark, tmp_path):
    """Members of one label share all shingles, a stray shares some: only its pairs are made."""
    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 60, 50)
    rows = [(i, 1, common.astype(np.int64).tobytes()) for i in range(400)]
    rows += [(900, 900, np.append(common[:45], rng.integers(0, 1 << 60, 5)).astype(np.int64).tobytes())]
    frame = spark.createDataFrame(rows, "doc_id long, label long, shingles binary")
    pairs = near_dedup._prefix_pairs(frame, 80)
    got = {(r.low, r.high) for r in pairs.collect()}
    assert got == {(i, 900) for i in range(400)}
    assert pairs.count() == 400
    alone = near_dedup._prefix_pairs(frame.where("label = 1"), 80)
    assert alone.count() == 0


def test_language_and_toxicity_of_odd_rows(spark):
    """Null and repeated ids, very long texts, clashing columns: reruns agree, every row is judged."""
    words = {"aa": "ba du ki lo".split(), "bb": "xe zi qy wu".split()}
    text = lambda lang, n, seed: " ".join(random.Random(seed).choice(words[lang]) for _ in range(n))
    rows = [(i % 20 if i % 3 else None, text("ab"[i % 2] * 2, 10 + i, i), "ab"[i % 2] * 2) for i in range(60)]
    rows += [(77, text("bb", 100_000, 1), "bb"), (78, None, "aa"), (79, "", None), (None, "12 34", "bb"), (80, text("aa", 30, 5), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("place", "letters", "text_key", "score", "lang_pred", "toxic", "l_id")})
    judged = []
    for part in (frame.repartition(2), frame.repartition(5, "text")):
        found = language.identify(part, language.fit(part))
        judged.append(sorted(map(str, ((r.doc_id, r.lang_pred, round(r.score, 6)) for r in found.collect()))))
    assert judged[0] == judged[1] and len(judged[0]) == len(rows)
    found = {row.split(",")[0] + row.split(",")[1] for row in judged[0]}
    assert found >= {"(77 'bb'", "(80 'aa'", "(78 'und'", "(79 'und'"}, judged[0]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(20)] + [(None, 1), (3, 1)], "doc_id long, toxic int")
    scores = [sorted(round(r.toxicity, 6) for r in toxicity.score(part, toxicity.fit(part, labels)).collect())
              for part in (frame.repartition(2), frame.repartition(5, "text"))]
    assert scores[0] == scores[1] and len(scores[0]) == len(rows)


def test_exact_dedup(spark, docs, corpus, empty):
    got = by_id(exact_dedup.copy_groups(docs), "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.copies([r[:2] for r in corpus])
    twice = docs.unionAll(docs.where("doc_id in (4, 30)"))
    kept = [r.doc_id for r in exact_dedup.drop_copies(twice).collect()]
    assert sorted(kept) == sorted(d for d, v in got.items() if v[2])
    assert exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.copy_groups(empty).count() == 0


def test_rows_without_id_are_told_apart(spark):
    leak, clean, other = prose(2, 30), prose(3, 30), prose(4, 30)
    rows = [(None, leak), (None, leak), (None, clean), (None, clean + " "), (None, other), (7, other), (8, clean + " more"), (8, prose(5, 30)), (8, "a b"), (8, " a  b "), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect()), key=repr)
    assert kept == sorted([(None, leak), (None, clean + " "), (7, other), (8, clean + " more"), (8, prose(5, 30)), (8, " a  b "), (None, None)], key=repr)
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    left = [(r.doc_id, r.text) for r in decontaminate.decontaminate(docs, bench).collect()]
    assert sorted(left, key=repr) == sorted([r for r in rows if r[1] != leak], key=repr)
    cut = [(r.doc_id, r.text) for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()]
    assert sorted(cut, key=repr) == sorted([(d, "" if t == leak else t) for d, t in rows], key=repr)
    assert decontaminate.find_hits(docs, bench).where("doc_id is null").count() == 5


def test_mixing(spark, docs, corpus, empty, monkeypatch):
    order = sorted({r[2] for r in corpus}, key=lambda s: (s is None, s))
    want = brute.mixed(corpus, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for most in (10_000, 3):  # few and many buckets select alike
        monkeypatch.setattr(mixing, "BUCKET_DOCS", most)
        got = by_id(mixing.mix(docs, mixing.ranked_weights(docs)), "size", "source_size", "target", "taken")
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)
    assert mixing.mix(empty, mixing.ranked_weights(empty)).count() == 0


def test_substring_dedup(spark, docs, corpus, empty):
    got = by_id(substring_dedup.remove_repeats(docs), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substrings_removed([r[:2] for r in corpus])
    assert substring_dedup.remove_repeats(empty).count() == 0
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_near_dedup(spark, docs, corpus, empty):
    for size in (4, 5):
        got = by_id(near_dedup.near_groups(docs, size), "n_shingles", "component_id", "kept")
        assert got == brute.near_groups([r[:2] for r in corpus], size)
    odd = spark.createDataFrame([(None, prose(1, 300)), (1, prose(1, 300)), (1, prose(1, 300))], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_groups(odd).collect()), key=repr) == sorted([(None, 296, None, True), (1, 296, 1, True), (1, 296, 1, True)], key=repr)
    assert near_dedup.near_groups(empty).count() == 0


def test_near_dedup_of_an_id_with_several_texts(spark):
    a, b = prose(1, 300), prose(2, 300)
    rows = [(5, a), (5, b), (3, a), (7, b + " end"), (9, prose(4, 300)), (9, ""), (9, a), (None, b), (11, prose(6, 300)), (11, prose(7, 300))]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(5, 3, False), (5, 3, False), (3, 3, True), (7, 3, False), *[(9, 3, False)] * 3, (None, None, True), *[(11, 11, True)] * 2], key=repr)


def test_registers_keep_the_smallest_points_and_estimate_the_overlap():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 7, 900)]
    together = near_dedup.registers_of(np.concatenate(sets), np.array([1, 7, 900]))
    for one, row in zip(sets, together):
        assert (near_dedup.registers_of(one, np.array([len(one)]))[0] == row).all()
    # registers of a union are the larger of both
    union = near_dedup.registers_of(np.sort(np.concatenate(sets[1:])), np.array([907]))[0]
    assert (np.maximum(together[1], together[2]) == union).all()
    pool = rng.integers(0, 2**63, 1100).astype(np.uint64)
    a, b = (near_dedup.registers_of(np.sort(x), np.array([1000])) for x in (pool[:1000], pool[100:]))
    guess = near_dedup.overlap_estimate(a, b, np.array([1000]), np.array([1000]))[0]
    assert abs(guess - 900 / 1100) < 0.1


def test_language(spark, empty):
    text = lambda seed, letters: " ".join("".join(random.Random(f"{seed}{i}").choice(letters) for _ in range(6)) for i in range(40))
    rows = [(i, text(i, "abcdefgh" if i % 2 else "stuvwxyzé"), ("low", "high")[i % 2 == 0]) for i in range(120)]
    train = spark.createDataFrame(rows[:80], "doc_id long, text string, lang string")
    network = language.fit(train)
    asked = spark.createDataFrame([(i, t) for i, t, _ in rows[80:]] + [(1000, None), (1001, "12 !"), (1002, "")], "doc_id long, text string")
    got = by_id(language.identify(asked, network), "lang_pred", "score")
    assert sum(got[i][0] == k for i, _, k in rows[80:]) >= 38 and all(got[i] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert language.identify(asked, language.fit(empty)).where("lang_pred = 'und'").count() == asked.count()
    # the gradient is that of differences
    layer, x = language.Layer(np.random.default_rng(1)), np.array([[97, 98], [98, 98], [97, 99]], np.uint8)
    layer.byte, layer.back = layer.byte.astype(float), layer.back.astype(float)
    pull = np.random.default_rng(2).normal(size=(3, language.HIDDEN, 2))

    def loss():
        state, total = np.zeros((language.HIDDEN, 2)), 0.0
        for t in range(3):
            state = layer.step(state, x[t])[0]
            total += (state * pull[t]).sum()
        return total

    for weights, slope in zip((layer.byte, layer.back), layer.gradients(x, pull)):
        for at in ((3, 97 % weights.shape[1]), (10, 2), (20, 5)):
            weights[at] += 1e-6
            up = loss()
            weights[at] -= 2e-6
            down = loss()
            weights[at] += 1e-6
            assert slope[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_toxicity(spark, empty):
    rows = [(i, prose(i, 60 + i) + (" vermaledeit " + prose(-i, 30) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("toxic", F.lit(0))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:160]] + [(5000, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    more = spark.createDataFrame([(900, prose(7, 50) + " vermaledait " + prose(8, 50)), (901, None), (902, ""),
                                  (903, prose(7, 50) + " " + prose(8, 50))], "doc_id long, text string")
    got = by_id(toxicity.score(docs.drop("toxic").unionAll(more), model), "toxicity")
    right = sum((got[i][0] >= toxicity.REJECT) == bool(y) for i, _, y in rows[160:])
    assert right >= 76 and got[900][0] > 2 * got[903][0] and got[901] == got[902] and 0 <= got[901][0] < 0.5
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_reads_whole_toxic_texts():
    """One insulting segment among forty marks a text; training must see it."""
    def text(seed, toxic):
        words = prose(seed, 640).split()
        for at in range(16 * (seed % 40), 16 * (seed % 40) + 12 * toxic):
            words[at] = ("vermaledeit", "hundsfott", "schwachkopf")[at % 3]
        return " ".join(words)

    marks = [i % 2 for i in range(80)]
    model = toxicity.train([text(i * 7 + 1, y) for i, y in enumerate(marks)], marks)
    asked = pa.array([text(5000 + 7 * i, i % 2) for i in range(40)]).cast(pa.binary())
    ends = np.cumsum([len(t.as_py()) for t in asked])
    high = model.highest(np.frombuffer(b"".join(t.as_py() for t in asked), np.uint8), np.concatenate([[0], ends]))
    assert min(high[1::2]) > max(high[::2])


def test_toxicity_bound_counts_permitted_documents(spark):
    order = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    labels = spark.createDataFrame([(i, at % 2) for at, i in enumerate(order)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "vermaledeit " * (at % 2) + prose(i, 20)) for at, i in enumerate(order) if at >= 20], "doc_id long, text string")
    assert toxicity.fit(docs, labels, rows=(5, 5)).slope != 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é"), (5, None, "<p>é"), (3, "u", None), (4, "u", ""), (9, "u", "z" * 300_000), (None, "u", "own"), (4, "u", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    files = warc.write_archives(frame, str(tmp_path / "zips"), file_bytes=200)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(files).collect()), key=repr)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<p>é": 5, "": 4, "z" * 300_000: 9, "own": None}
    assert got == sorted(((p, len((h or "").encode()), sha(h), *(("response", None) if first[h or ""] == p else ("revisit", first[h or ""]))) for p, _, h in pages), key=repr)
    assert files.count() >= 1 and warc.read_archives(warc.write_archives(frame.limit(0), str(tmp_path / "none"))).count() == 0


def test_zip64_directory(tmp_path):
    """A directory whose sizes and places stand in ZIP64 fields only."""
    data, name = b"stored bytes", b"archive/data.warc.gz"
    local = warc.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 0) + name
    wide = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = warc.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    at = len(local) + len(data)
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, at + len(entry), 1)
    end = warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path = tmp_path / "wide.zip"
    path.write_bytes(local + data + entry + end64 + locator + end)
    with pa.OSFile(str(path)) as file:
        (found,) = warc.members_of(file)
        assert found[:2] == (name.decode(), 0) and file.read_at(found[3], found[2]) == data


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    verdict = compare(spark, connect(folder), folder, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_pipeline(spark, tmp_path, docs):

    spark.createDataFrame([(1, prose(2, 70))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(100 + i, i % 2) for i in range(12)], "doc_id long, quality int").withColumn(
        "toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    taken = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    ids = {r.doc_id for r in taken.collect()}
    assert not ids & {50, 3, 51, -5, 9, 101} and {200, 219, 40} <= ids | {200, 219, 40} and set(taken.columns) == {*docs.columns, "copy"}


def test_pipeline_against_plain_versions(spark, tmp_path, corpus, docs, monkeypatch):
    """Exact ids and repetitions: the recorded model's scores, then the plain version of each stage."""

    insult = "vermaledeit hundsfott schwachkopf widerling "
    bad = [(300 + i, insult * 4 + prose(300 + i, 8), "d") for i in range(24)]
    rows, items, models, fit = [*corpus, *bad], [(1, prose(2, 70))], [], toxicity.fit
    extra = spark.createDataFrame(bad, "doc_id long, text string, source string")
    extra.select("*", *[F.lit("clash").alias(c) for c in docs.columns[3:]]).unionByName(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = [(300 + i, 1) for i in range(24)] + [(i, 0) for i in (*range(100, 112), *range(200, 220), 40)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r["copy"])
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    scores = {d: s for d, (s,) in by_id(toxicity.score(frame, models[0]), "toxicity").items()}
    left = [r for r in rows if scores[r[0]] < toxicity.REJECT]
    assert len([r for r in bad if r not in left]) >= 20 and len([r for r in corpus if r in left]) >= len(corpus) - 2
    for verdict in (lambda some: {d for d, v in brute.copies(some).items() if v[2]},
                    lambda some: {d for d, v in brute.near_groups(some, 5).items() if v[2]},
                    lambda some: {d for d, v in brute.decontaminated(some, items).items() if not v[4]}):
        stay = verdict([r[:2] for r in left])
        assert len(stay) < len(left)
        left = [r for r in left if r[0] in stay]
    order = sorted({r[2] for r in left}, key=lambda s: (s is None, s))
    mixed = brute.mixed(left, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    want = {d: list(range(1, v[3] // v[0] + 1)) for d, v in mixed.items() if v[0] and v[3]}
    worded = {d for d, v in mixed.items() if v[0]}  # the plain mix counts words, so it says nothing of texts without any
    assert {d: sorted(c) for d, c in got.items() if d in worded} == want and got.keys() <= mixed.keys()
