"""Operators against plain recomputations, over rows that break things and over the pipeline's stages."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarack.llm import bpe, chat, fingerprints, mixing, near_dup, quality_model, repetition, secret_scan, token_count, token_store
from tamarack.llm.common import by_bytes, remove_rows, told_apart
from tamarack.llm.oracles import ORACLE_SQL
from tamarack.llm.queries import QUERIES
from tamarack.runtime import shared_dir

DATA = "/root/testdata/sf0.001"
BYTE, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, other = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    place = [other.columns.index(c) for c in columns]
    assert sorted(map(repr, ([r[c] for c in columns] for r in df.collect()))) == sorted(map(repr, ([r[i] for i in place] for r in other.fetchall())))


# --- odd rows: null ids, repeats, one id with several texts, and columns that clash with names used inside

PROSE = "the quick brown fox jumps over the lazy dog and runs away from all the noise that it has made in the yard"
ODD = [(None, None), (None, ""), (None, PROSE), (None, PROSE), (5, PROSE), (5, PROSE), (5, PROSE + " again"), (6, "secret=abcdef123 " * 3), (6, None), (-7, "é " * 40), (2**62 + 1, "x" * 5000), (9, PROSE.upper()), (10, "one"), (11, "one")]
CLASH = ["whole", "fillers", "upto", "partial", "p_source", "block_cut", "__key", "__block", "__source_size", "__size", "__takes", "__places", "__place", "__shard", "__row", "levels", "target", "id", "d0", "n", "key", "a", "b", "rules", "spans", "part", "s_id", "s_first", "__text", "label", "x", "__score"]


@pytest.fixture(scope="module")
def odd(spark):
    made = [(i, t, "s" if k % 3 else None, *["v"] * len(CLASH)) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(made, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(4).cache()


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_odd_rows_tokens(spark, odd):
    library = {p: Tokenizer.from_file(p) for p in (BYTE, WORDS)}
    ids = lambda t, p: library[p].encode(t or "", add_special_tokens=False).ids
    assert rows_of(bpe.encode_digests(odd, WORDS), "doc_id", "n_tokens", "ids_sha256") == Counter((i, len(ids(t, WORDS)), sha(" ".join(map(str, ids(t, WORDS))))) for i, t in ODD)
    assert rows_of(token_count.count_tokens(odd, BYTE), "doc_id", "n_bytes", "n_tokens") == Counter((i, len((t or "").encode()), len(ids(t, BYTE))) for i, t in ODD)
    out = shared_dir(spark, "store")
    token_store.write_token_store(odd, out, BYTE)
    store = token_store.read_token_store(spark, out)
    start, expected = 0, Counter()
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = [*ids(t, BYTE), 0]
        expected[i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
        start += len(x)
    assert rows_of(token_store.with_start(token_store.digests(store), store), "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_odd_rows_near_duplicates(odd):
    got = rows_of(near_dup.near_duplicates(odd, 2), "doc_id", "n_shingles", "component_id", "kept")
    shingles = lambda t: (lambda w: len({tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))}) if w else 0)([x.lower() for x in WORD.findall(t or "")])
    expected = Counter((i, shingles(t), None if i is None else {9: 5, 11: 10}.get(i, i), i not in (9, 11)) for i, t in ODD)
    assert got == expected


def test_ids_that_are_not_whole_numbers(odd):
    named = odd.withColumn("doc_id", F.col("doc_id").cast("string"))
    for f in (near_dup.near_duplicates, fingerprints.compare_with_next, lambda d: token_store.write_token_store(d, "/nowhere", BYTE)):
        with pytest.raises(TypeError, match="whole numbers"):
            f(named)
    for f in (lambda d: bpe.encode_digests(d, WORDS), lambda d: token_count.count_tokens(d, WORDS), repetition.quality_rules, secret_scan.scan, mixing.placed, fingerprints.fingerprint):
        assert f(named).count() == len(ODD)


def test_odd_rows_rules_and_secrets(odd):
    def measured(t):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        return len(w), len(hit)

    assert rows_of(repetition.quality_rules(odd), "doc_id", "n_words", "n_repeat_words") == Counter((i, *measured(t)) for i, t in ODD)
    found = secret_scan.report(secret_scan.scan(odd, keep=("source", "rules", "spans")))
    assert rows_of(found, "doc_id", "n_assign") == Counter((i, (t or "").count("secret=")) for i, t in ODD)


def test_odd_rows_quality(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, None), (9, 1), (10, 0), (None, 1)], "doc_id long, quality int")
    model = quality_model.train(odd, labels, train_rows=3)
    scored = quality_model.score(odd, model)
    assert scored.columns == [*[c for c in odd.columns if c != "__score"], "__score"] and rows_of(scored, "doc_id", "text") == Counter(ODD)
    by_text = {}
    assert all(by_text.setdefault(r.text or "", r["__score"]) == pytest.approx(r["__score"], abs=1e-9) and 0 <= r["__score"] <= 1 for r in scored.collect())


def test_mixing_keeps_columns_of_any_name(odd):
    placed = mixing.placed(odd)
    assert [c for c in placed.columns if c not in mixing._PLACED] == [c for c in odd.columns if c not in mixing._PLACED]
    assert rows_of(placed, "doc_id", "text", "whole", "__shard", "id") == Counter((i, t, "v", "v", "v") for i, t in ODD)
    mixed = mixing.mix(odd)
    assert mixed.columns == [*[c for c in odd.columns if c not in mixing._MIXED], *mixing._MIXED]
    assert mixed.count() == sum(len(r["__places"]) for r in placed.collect())


def test_remove_rows(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "d", 4), (None, "d", 4)], "doc_id long, text string, __row int")
    gone = spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")
    assert rows_of(remove_rows(docs, gone), "doc_id", "text", "__row") == Counter([(1, "a", 1), (3, "c", 3), (None, "d", 4), (None, "d", 4)])
    told = told_apart(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (2, "b", 3)], "doc_id long, text string, s_id int"))
    nodes = {(r.doc_id, r.text): r["__node"] for r in told.collect()}
    assert len(set(nodes.values())) == 3 and nodes[2, "b"] == 2 and sorted(nodes.values())[0] == 1 and max(nodes.values()) >= 2**62


def test_batches_are_balanced_by_bytes():
    rng = random.Random(1)
    items = ["漢" * rng.randint(0, 300) for _ in range(400)] + ["a" * rng.randint(0, 900) for _ in range(400)]
    parts = by_bytes(items, 10_000)
    sizes = [sum(len(x.encode()) + 16 for x in p) for p in parts]
    assert [x for p in parts for x in p] == items and len(parts) == math.ceil(sum(sizes) / 10_000)
    assert max(sizes) - min(sizes) <= 2 * 916 and by_bytes([], 5) == []


def test_sentencepiece_counts():
    import pyarrow as pa
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    parts = [" ", " ", "  ", "\n", "a", "word", "The", "1", "é", "\u0301", "漢", ".", "\u2581", "\t", "ing", "\xa0", "<s>", "ﬁ"]
    texts = [None, "", " ", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(4000)), "the word is one " * 5000]
    assert token_count._begins_words(model)
    assert token_count._counter(path)(pa.array(texts)).tolist() == [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]


# --- fingerprints by a plain chunker


def _plain_chunks(data):
    """Cuts byte by byte: sixteen shifts push a byte out of the 16-bit hash."""
    out, start, h = [], 0, 0
    table = [int(x) for x in fingerprints._GEAR]
    hashes = []
    for i in range(len(data)):
        h = sum(table[data[i - k]] << k for k in range(min(i + 1, 16))) & 0xFFFF
        hashes.append(h)
    while start < len(data):
        end = min(start + fingerprints.MAX, len(data))
        if len(data) - start > fingerprints.MIN:
            for at in range(start + fingerprints.MIN, end):
                mask = int(fingerprints.RARE_MASK if at < start + fingerprints.NORMAL else fingerprints.COMMON_MASK)
                if hashes[at - 1] & mask == 0:
                    end = at
                    break
        out.append(data[start:end])
        start = end
    return out


def test_chunker_by_hand():
    rng = random.Random(9)
    texts = [b"", b"a", bytes(rng.randrange(256) for _ in range(3000)), " ".join("".join(rng.choice("abcdeinorst") for _ in range(6)) for _ in range(600)).encode(), b"x" * 700, "é漢字".encode() * 200]
    together = fingerprints.chunk_sets(texts)
    seen = {}
    for text, chunks in zip(texts, together, strict=True):
        plain = _plain_chunks(text)
        assert sorted((np.array([len(x) for x in set(plain)], np.uint64)).tolist()) == sorted((chunks & np.uint64(0xFFFF)).tolist())
        for piece in set(plain):
            (alone,) = fingerprints.chunk_sets([piece])
            if len(_plain_chunks(piece)) == 1:
                assert alone[0] in chunks and seen.setdefault(int(alone[0]), piece) == piece


# --- quality: the fit is the optimum of its objective


def test_bradley_terry_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    better = x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.8, size=300) > 0.3
    pairs, penalty, seed = 2000, 1e-2, 4
    model = quality_model.fit(x, better, pairs, penalty, seed)
    draw = np.random.default_rng(seed)
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    f = model.features(x)
    left, right = draw.choice(good, pairs), draw.choice(bad, pairs)

    def loss(w):
        return sum(math.log1p(math.exp(-float((f[i] - f[j]) @ w))) for i, j in zip(left, right, strict=True)) / pairs + penalty / 2 * float(w @ w)

    best = loss(model.weights)
    assert all(loss(model.weights + step) > best for step in rng.normal(scale=0.05, size=(12, f.shape[1])))
    raw = f @ model.weights
    assert (raw < model.threshold).mean() == pytest.approx(len(bad) / 300, abs=0.01)
    s = model.score(x)
    assert ((s >= 0.5) == (raw >= model.threshold)).all() and np.mean((s >= 0.5) == better) > 0.75


def _gradient_of_all_pairs(model, x, better, penalty):
    f = model.features(x)
    diff = (f[better][:, None] - f[~better]).reshape(-1, f.shape[1])
    return diff.T @ (1 / (1 + np.exp(-(diff @ model.weights))) - 1) / len(diff) + penalty * model.weights


@pytest.mark.parametrize("few", [1 << 16, 40])
def test_fit_uses_all_pairs(monkeypatch, few):
    monkeypatch.setattr(quality_model, "_FEW", few, raising=False)
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(250, 4)), rng.standard_cauchy(size=(250, 3)), np.round(rng.normal(size=(250, 2)))):
        better = x[:, 0] + rng.normal(scale=0.6, size=len(x)) > 0.3
        model = quality_model.fit(x, better, penalty=1e-2)
        assert np.abs(_gradient_of_all_pairs(model, x, better, 1e-2)).max() < 1e-9
        assert model.cuts == pytest.approx(np.quantile(x, quality_model._QUANTILES, axis=0), abs=1e-12)
        assert model.threshold == pytest.approx(np.quantile(model.raw(x), np.mean(~better)), abs=1e-12)


def test_training_uses_all_rows(spark):
    # more rows than the 20,000 that training once took, in several parts
    df = spark.range(40_000, numPartitions=5).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("a b "), (F.col("id") % 7).cast("int")), F.hex(F.xxhash64("id"))).alias("text"))
    labels = df.select("doc_id", (F.xxhash64("doc_id", F.lit(1)) % 7 < F.col("doc_id") % 7 - 3).cast("int").alias("quality"))
    model = quality_model.train(df, labels)
    rows = df.join(labels, "doc_id").where(~quality_model.held_out("doc_id")).collect()
    x, better = quality_model.measures([r.text.encode() for r in rows]), np.array([r.quality > 0 for r in rows])
    assert len(rows) > 26_000 and model.cuts == pytest.approx(np.quantile(x, quality_model._QUANTILES, axis=0), abs=1e-12)
    alone = quality_model.fit(x, better)
    assert model.scales == pytest.approx(alone.scales, rel=1e-9) and model.weights == pytest.approx(alone.weights, abs=1e-6)
    assert model.threshold == pytest.approx(np.quantile(model.raw(x), np.mean(~better)), abs=1e-12)


# --- mixing: targets by another way, and the tree's shards


def _water_level(sizes, weights, limit):
    """Targets min(limit * size, weight * level) that add up to all sizes, the level by bisection."""
    low, high = 0.0, 10.0 * sum(sizes) + 1
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(limit * s, w * level) for s, w in zip(sizes, weights, strict=True)) < sum(sizes):
            low = level
        else:
            high = level
    return [min(limit * s, w * high) for s, w in zip(sizes, weights, strict=True)]


def test_mixing_query_by_brute_force(spark):
    rows = QUERIES["op5_mixing"](spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(WORD.findall(d.text or ""))
    names = sorted(x for x in sizes if x is not None) + ([None] if None in sizes else [])
    target = dict(zip(names, _water_level([sizes[x] for x in names], [1 + i % 3 for i in range(len(names))], 3), strict=True))
    taken = Counter()
    for r in rows:
        d = docs[r.doc_id]
        shards = [int(x) for x in r.shards.split(",") if x]
        assert r.size == len(WORD.findall(d.text or "")) and r.source_size == sizes[d.source] and r.target == pytest.approx(target[d.source], rel=1e-6)
        assert r.taken == r.size * len(shards) <= 3 * r.size
        taken[d.source] += r.taken
    for s in names:
        rest, mine = target[s] - taken[s], [r for r in rows if docs[r.doc_id].source == s and r.size]
        # what is missing is next to nothing, or less than every document that the last pass left out
        assert rest >= -1 and (rest <= 0.0005 * target[s] + 1 or all(r.size > rest or r.taken for r in mine)), (s, rest)
        assert rest <= max((r.size for r in mine), default=0)


def test_tree_fills_its_quotas(spark):
    """Whole passes: with one document a block or more, each shard holds as many block passes of each source as the tree drew."""
    made = [(i, "w " * (1 + i % 3), f"s{i % 2}") for i in range(40_000)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    settings = {"shard_words": 16_000, "weights": (1.0, 1.0)}
    rows, _ = mixing._plain(df, mixing._PLACED, "doc_id", "source", "text")
    plan = {x["source"]: x for x in mixing.plan(mixing._light(rows, 5), **settings)}
    keyed = mixing._placed(rows, 3, 5, **settings).select("source", "__block", F.posexplode("__places").alias("k", "p")).select("source", "__block", "p.pass", "p.shard").distinct().collect()
    for s, x in plan.items():
        quota = np.diff([0, *x["upto"]])
        assert len(quota) == 5 and quota.sum() == x["blocks"]
        if x["whole"] == 1 and not x["levels"]:
            mine = [r for r in keyed if r.source == s]
            assert Counter(r.shard for r in mine) == Counter({i: int(q) for i, q in enumerate(quota) if q})
            assert len({(r["__block"], r["pass"]) for r in mine}) == len(mine) == mixing.BLOCKS
    order = spark.range(mixing.BLOCKS).selectExpr("CAST(id AS INT) AS b").selectExpr(f"{mixing._permuted('b', '5, 0')} AS p", f"{mixing._permuted('b', '6, 0')} AS q").collect()
    assert sorted(r.p for r in order) == list(range(mixing.BLOCKS)) != [r.p for r in order] and [r.p for r in order] != [r.q for r in order]


# --- secrets: any number of spans


def test_very_many_secrets(spark):
    rng = random.Random(4)
    parts = ["".join(rng.choice("0123456789abcdef") for _ in range(24 + rng.randint(0, 8))) for _ in range(160_000)]
    text = " é".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (r,) = secret_scan.report(secret_scan.scan(df)).collect()
    at, spans = 0, []
    for x in parts:
        spans.append(f"hex:{at}:{at + len(x)}")
        at += len(x) + 2
    assert r.n_hex == len(parts) and r.base_sha256 == sha(",".join(spans))
    (t,) = secret_scan.scan(df).select(secret_scan.redacted().alias("t")).collect()
    assert t.t == " é".join(["[SECRET]"] * len(parts)) and time.time() - began < 30


def test_redaction_by_hand(spark):
    rng = random.Random(6)
    pieces = ["token = abcdefgh12", "AKIA" + "Z" * 20, "0f" * 14, "é漢\U0001f600", " plain words ", "\n", "password=0123456789abcdef0123456789abcdef", "x" * 5000, "ghp_" + "a" * 40, "secret:token:abcdef"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(df).select("doc_id", "text", "spans", secret_scan.redacted().alias("t")).collect():
        out, at = "", 0
        for s in r.spans:
            if s.start >= at:
                out += r.text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r.t == out + r.text[at:], r.doc_id


def test_long_conversation(spark):
    long = "say <|im_end|> again and again " * 20_000
    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], long if k < 2 else None) for k in range(300)], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.format_conversations(df, BYTE), BYTE).collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (300, len(long), sha(long))


# --- the pipeline, stage by stage


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    from tamarack.runtime import materialize
    from tests.llm.test_operators import ASSIGN, _components

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    text_of = lambda df: {r.doc_id: r for r in df.collect()}
    start = text_of(docs)

    kept = materialize(stages["quality classifier"](spark, docs, DATA), "stage")
    model = quality_model.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {i for i, r in start.items() if model.score(quality_model.measures([(r.text or "").encode()]))[0] >= 0.5}
    assert text_of(kept) == {i: start[i] for i in good} and 0 < len(good) < len(start)

    single = materialize(stages["MinHash near-dedup"](spark, kept, DATA), "stage")
    groups = _components([(i, start[i].text) for i in sorted(good)], 5)
    assert text_of(single) == {i: start[i] for i in good if groups[i][1] == i}

    clean = materialize(stages["secret scans"](spark, single, DATA), "stage")
    patterns = [(re.compile(r.pattern) if r.kind != "assign" else ASSIGN, r.group, r.least) for r in secret_scan.RULES]
    for i, r in text_of(clean).items():
        text, spans = start[i].text or "", []
        for p, group, least in patterns:
            spans += [m.span() for m in p.finditer(text) if len(m[group]) >= least]
        out, at = "", 0
        for a, b in sorted(spans):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert (r.text or "") == out + text[at:] and r.n_chars == len(r.text or "") and (r.lang, r.source) == (start[i].lang, start[i].source)

    mixed = materialize(stages["mixing sources to target weights"](spark, clean, DATA), "stage")
    times = {r.doc_id: len(r["__places"]) for r in mixing.placed(clean).collect()}
    cleaned = text_of(clean)
    assert Counter(tuple(r) for r in mixed.collect()) == Counter({tuple(cleaned[i]): n for i, n in times.items() if n})

    library = Tokenizer.from_file(WORDS)
    ids = {i: tuple(library.encode(r.text or "", add_special_tokens=False).ids) for i, r in cleaned.items()}
    encoded = stages["BPE encoding and decoding"](spark, mixed, DATA)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter({(i, ids[i]): n for i, n in times.items() if n})
