"""Centroids, manifest and byte pairs against plain versions, with the rows that break things."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from courtside.llm import bpe, centroids, manifest
from courtside.llm.queries import ORACLES, QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


# --- centroids --------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=order)[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[nearest(v)].append(v)
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(own, centres)]
    last = [(i, c := nearest(v), far(v, centres[c])) for i, v in kept]
    return sorted(((i, c, d if d < 2**63 else None) for i, c, d in last), key=repr), centres


def found_clusters(frame, **how):
    found = centroids.cluster(frame, **how)
    rows = found.assigned.collect()
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=repr), found.centroids, rows


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "huge"])
def test_centroids(spark, kind):
    rng = random.Random(kind)
    dims = 64 if kind == "spread" else 4
    if kind == "spread":
        middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
        rows = [(i, [m + rng.gauss(0, 0.3) for m in middles[i % 6]]) for i in range(300)]
    elif kind == "grid":  # many equal distances
        rows = [(i, [rng.randint(-1, 1) / 1024 for _ in range(dims)]) for i in range(300)]
    elif kind == "copies":
        rows = [(i % 40, [1.0, 2.0, 3.0, float(i % 3)]) for i in range(200)] + [(None, [0.0] * 4), (None, [1.0] * 4)]
    else:
        rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice((0, 3, 6, 30)) for _ in range(dims)]) for i in range(120)]
        rows.append((999, [1e307, 0.0, 0.0, 0.0]))
    bad = [(1000, None), (1001, []), (1002, [1.0] * (dims - 1)), (1003, [1.0] * (dims - 1) + [None]), (1004, [float("nan")] * dims),
           (1005, [float("-inf")] + [0.0] * (dims - 1)), (1006, [1.0] * (dims + 1))]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    frame = frame.withColumns({c: F.lit("clash") for c in ("value", "apex", "cluster", "distance", "part")})
    kept = [r for r in rows if r[0] != 999]  # its thousandfold is no double
    want, centres = plain_clusters(kept, 8, 10, dims)
    got, own, out = found_clusters(frame, dims=dims)
    assert got == want and own == centres
    if kind != "huge":
        assert {r["inertia"] for r in out} == {sum(d for _, _, d in want)}
        assert {(r["cluster"], r["cluster_inertia"]) for r in out} == {(c, sum(d for _, x, d in want if x == c)) for _, c, _ in want}
    else:
        assert {r["inertia"] for r in out} == {None}


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-900, 900, (8, 64))
    rows = (middles[rng.integers(0, 8, 2000)] + rng.integers(-60, 60, (2000, 64))).astype(np.float64)
    simplex = centroids.Simplex(rows[:64])
    theirs = simplex.apexes(middles.astype(np.float64))
    mine = simplex.apexes(rows).astype(np.float32).astype(np.float64)
    true = ((rows[:, None] - middles[None]) ** 2).sum(2)
    low = ((mine[:, None] - theirs[None]) ** 2).sum(2)
    mirrored = theirs * np.where(np.arange(theirs.shape[1]) == theirs.shape[1] - 1, -1, 1)
    high = ((mine[:, None] - mirrored[None]) ** 2).sum(2)
    assert (low <= true * (1 + 1e-4) + 1).all() and (true <= high * (1 + 1e-4) + 1).all()
    left = centroids.candidates(mine, theirs)
    assert left[np.arange(2000), true.argmin(1)].all() and left.sum() < 2000 * 3


def test_few_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = centroids.cluster(empty)
    assert found.centroids == [] and found.assigned.count() == 0
    two = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    got, centres, _ = found_clusters(two)
    assert len(centres) == 2 and [d for _, _, d in got] == [0, 0]
    with pytest.raises(ValueError):
        centroids.cluster(two, dims=0)


# --- manifest ---------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) per row of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf((*r[:3], r[3] + 1 if tampered and r[3] is not None else r[3], r[4]))
            proof = []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    beside = level[at ^ 1] if at ^ 1 < len(level) else None
                    proof += [beside] if beside else []
                    fold = sha(fold if beside is None else beside + fold if at & 1 else fold + beside)
                    at >>= 1
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], tuple(proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(frame):
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(tampered, manifest.digest([*columns[:3], F.col("n_chars") + 1, F.col("text")])).otherwise(manifest.digest(columns))
    return manifest.build(frame, F.col("lang"), F.col("doc_id"), columns, doc_id=F.col("doc_id"), claim=claim)


def proven(found, wanted):
    rows = manifest.prove(found, wanted, {"doc_id": pa.int64()}).collect()
    for r in rows:
        assert r["proof_sha256"] == sha("".join(r["proof"]))
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(r["proof"]), r["folded_root"], r["verified"]) for r in rows), key=repr)


@pytest.fixture
def leaves():
    rng = random.Random(8)
    rows = [(i, f"src{i % 3}", rng.choice(["en"] * 6 + ["de", "é", "zz", "Z"]), i * 3, f"text é {i}" * (i % 5)) for i in range(203)]
    rows += [(None, None, None, None, None), (None, "x", None, None, ""), (5000, "s", "", 0, ""), (5001, "s", "only", None, None)]
    rows += [(7, "src1", "en", 21, "other"), (7, "src1", "en", 21, "other")] + [(400, "a", "en", 1, "copy")] * 40 + [(-3, "b", "en", 2**40, "x" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [2, 12])
def test_manifest(spark, leaves, monkeypatch, span):
    monkeypatch.setattr(manifest, "SPAN", span)
    frame = spark.createDataFrame(leaves, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("tree", "pos", "size", "digest", "level", "block", "of", "up")})
    found, want = made(frame), plain_manifest(leaves)
    assert found.root == want[0][3]
    assert proven(found, found.leaves) == want
    assert any(not w[6] for w in want) and any(w[6] for w in want)
    # some rows only: their union of missing nodes is fetched, and the proofs are the same
    some = {-3, 7, 11, 12, 60, 100, 101, 102, 103, 5000, 5001}
    assert proven(found, found.leaves.where(F.col("doc_id").isin(*some))) == [w for w in want if w[0] in some]


def test_octopus_fetches_no_node_that_can_be_derived():
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 8, 21, 64):
        tree = plain_tree([sha(str(i)) for i in range(size)])
        for _ in range(20):
            places = sorted(rng.sample(range(size), rng.randint(1, size)))
            need = manifest.missing(places, size)
            paths = {(level, p >> level) for p in places for level in range(len(tree))}
            beside = {(level, at ^ 1) for level, at in paths if level < len(tree) - 1 and at ^ 1 < len(tree[level])}
            assert len(need) == len(set(need)) and set(need) == beside - paths
            known = {(level, at): tree[level][at] for level, at in need} | {(0, p): tree[0][p] for p in places}
            assert manifest.derived(known, places, size) == tree[-1][0]


def test_small_manifests(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = made(empty)
    assert found.root is None and manifest.prove(found, found.leaves, {"doc_id": pa.int64()}).count() == 0
    one = [(5, "s", "en", 4, "text")]
    found = made(spark.createDataFrame(one, SCHEMA))
    assert found.root == leaf(one[0]) and proven(found, found.leaves) == plain_manifest(one)


# --- byte pairs -------------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(4)
    signs = "abcdefghij ABC   éñß中文😀1234!?'\n\t  \x1c"
    mixed = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    plain = [None, "", " ", "\n\n  \n", "it's we'll I'M <|endoftext|>", "a" * 5000, "ab" * 3000 + "c", " " * 3000 + "x", "中" * 900, "\u0000�", "don't" * 500]
    return plain + mixed + ["x y " * 30_000]


def test_bpe(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, decoded string").withColumn("__added", F.lit(1))
    found = bpe.encode(frame, RANKS, public_tokenizers.PATTERN)
    assert found.columns == [*frame.columns, "ids"]
    got = {r["doc_id"]: r for r in bpe.decode(found, RANKS).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        assert got[i]["ids"] == library.encode_ordinary(text or "") and bytes(got[i]["decoded"]) == (text or "").encode()
    empty = frame.limit(0)
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_bytes_that_are_no_text(spark, library):
    frame = spark.sql("select 1 as doc_id, cast(x'61ff62' as string) as text")
    assert bpe.encode(frame, RANKS, public_tokenizers.PATTERN).first()["ids"] == library.encode_ordinary("a�b")


def test_merges_of_one_piece_and_of_many(library):
    rng = random.Random(9)
    ranks = bpe.read_ranks(RANKS)
    pieces = [bytes(rng.choice(b"aabbcde \xc3\xa9\x00\xff") for _ in range(rng.randint(1, 64))) for _ in range(3000)]
    together = [np.frombuffer(x, "<i4").tolist() for x in bpe.merged_together(pieces, bpe.Pairs(ranks))]
    assert together == [bpe.merged(p, ranks) for p in pieces]
    # every merge by searching the lowest rank, leftmost
    for piece, ids in zip(pieces[:400], together):
        tokens = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(tokens, tokens[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            tokens[best[1]:best[1] + 2] = [tokens[best[1]] + tokens[best[1] + 1]]
        assert ids == [ranks[t] for t in tokens]


def test_stretches_are_the_matches_of_the_whole():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in texts()[1:]:
        for most in (1, 2, 7, 64):
            assert [p for found in bpe.stretches(text[:4000], pattern, most) for p in found] == pattern.findall(text[:4000])


def test_remembered_pieces_are_forgotten_in_time(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "STRETCH", 50)
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    some = [t or "" for t in texts()][:60]
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.ids(iter(some))] == [library.encode_ordinary(t) for t in some]


@pytest.mark.parametrize("name", ["op11_centroids", "op12_manifest"])
def test_queries_against_sql(spark, name):
    verdict = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op13_bpe"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        own = hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(ids), digest, own)


def test_first_per_group_of_a_group_that_holds_most_rows(spark):
    from courtside.llm.common import first_per_group

    rows = [("hot", i * 7 % 5003) for i in range(5000)] + [("cold", 3), (None, 2), (None, 1)]
    few = first_per_group(spark.createDataFrame(rows, "g string, at int").repartition(40), "g", "at", 20, 4)
    expected = {(g, a) for g in ("hot", "cold", None) for a in sorted(a for k, a in rows if k == g)[:20]}
    got = [tuple(r) for r in few.collect()]
    assert few.columns == ["g", "at"] and set(got) == expected and len(got) == len(expected)
