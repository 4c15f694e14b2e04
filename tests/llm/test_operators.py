"""Training-data operators against brute force, and on the rows that break things: nulls, empty and long texts, repeats, ties."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarack.llm import bpe, chat, fingerprints, mixing, near_dup, quality_model, repetition, secret_scan, segments, token_count, token_store
from tamarack.runtime import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, part int, key string, n int"
BYTE, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def _texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [None, "", " ", "\n\t", "one", "Two words", "é ß Σ İ 漢字 \U0001f600", "<|endoftext|> a<|startoftext|>b", "x" * 70_000, prose(9000), "AKIA" + "Z" * 20 + " token = abcdef0123", "secret=token: abcdef123"]
    base = prose(120)
    out += [base, base, base + " more", prose(3) + base, base.upper()]
    out += [prose(rng.randint(1, 200)) for _ in range(60)]
    out += ["be " * 50, "\n".join(["a line here"] * 8), "password: 'hunter22222' and " + "0f" * 20, "".join(f"{i:x}" * 30 + " " for i in range(16))]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    made = [(i * 3, t, None if i % 5 == 0 else f"s{i % 3}", "en", 1, "k", i) for i, t in enumerate(texts)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows, null ids, one id with two texts."""
    return spark.createDataFrame([*rows[:14], rows[12], rows[12], (None, "lost words", None, None, None, None, None), (None, None, None, None, None, None, None), (36, "another text", "s0", "en", 1, "k", 0)], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 1 token store


def test_token_store(spark, docs, rows, nothing, odd):
    out = shared_dir(spark, "store")
    token_store.write_token_store(docs, out, BYTE)
    store = token_store.read_token_store(spark, out)
    got = {r.doc_id: r for r in token_store.with_start(token_store.digests(store), store).collect()}
    tokenizer, start = Tokenizer.from_file(BYTE), 0
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in token_store.read_token_store(spark, out, [3]).collect()] == [3]
    plan = token_store.read_token_store(spark, out, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters", 1)[1][:60]
    for df, n in ((nothing, 0), (odd, odd.count())):
        other = shared_dir(spark, "store")
        token_store.write_token_store(df, other, BYTE)
        found = token_store.read_token_store(spark, other)
        assert token_store.with_start(token_store.digests(found), found).count() == n


# --- 2 BPE, 8 counts


@pytest.mark.parametrize("path", [WORDS, BYTE])
def test_bpe_is_the_library(path):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "bc", "D", "é", "1", "'s", "<|endoftext|>", ".", "!!", "\xa0", "漢", "\x1c", "'ll", "<|startoftext|>", "Σ", "ing", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["a" * 3000, "ab" * 2000] + [t or "" for t in _texts()]
    library, mine = Tokenizer.from_file(path), bpe.BpeModel.from_file(path)
    expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert mine.encode_batch(texts) == expected
    assert [mine.decode(x) for x in expected] == [library.decode(x, skip_special_tokens=False) for x in expected]
    assert list(token_count._counter(path)(pa.array(texts))) == [len(x) for x in expected]
    if path == BYTE:
        flat, counts = token_store.segment_ids(path).ids_of(pa.array(texts), 0)
        assert flat.tolist() == [y for x in expected for y in [*x, 0]] and counts.tolist() == [len(x) + 1 for x in expected]


@pytest.mark.parametrize("path", [WORDS, BYTE])
def test_bpe_of_all_code_points(path):
    """Each code point alone, between letters and before a combining mark; then random strings of characters and marks."""
    library, mine = Tokenizer.from_file(path), bpe.BpeModel.from_file(path)
    # for the byte-level file, planes with characters only
    points = [chr(x) for x in range(0x110000 if path == WORDS else 0x20000) if not 0xD800 <= x < 0xE000]
    texts = [" ".join(f"{c} a{c}a {c}\u0301" for c in points[i : i + 512]) for i in range(0, len(points), 512)]
    rng = random.Random(5)
    low = [c for c in points if c < "\u3000" or "\ua000" < c < "\U00020000"]
    marks = [c for c in low if unicodedata.combining(c)]
    texts += ["".join(rng.choice((rng.choice(low), rng.choice("aeiouAEIO n'\n"), rng.choice(marks))) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    for i in range(0, len(texts), 256):
        expected = [x.ids for x in library.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        assert mine.encode_batch(texts[i : i + 256]) == expected


def test_bpe_merges_where_speculation_fails():
    model = bpe.BpeModel.from_file(WORDS)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 24))) for _ in range(4000)] + ["", "ab" * 90, "z" * 200]
    exact = [model.merge(w) for w in words]
    flat, counts = model.encode_words([w.encode() for w in words])
    assert flat.tolist() == [y for x in exact for y in x] and counts.tolist() == list(map(len, exact))
    assert 0 < sum(model._propose(w) != e for w, e in zip(words, exact, strict=True)) < len(words)
    assert [model.encode_long(w) for w in words[-60:]] == exact[-60:]


def test_lookup():
    rng = np.random.default_rng(1)
    keys = rng.choice(10**12, 5000, replace=False)
    found = bpe.Lookup(keys, np.arange(5000))
    asked = np.concatenate([keys, rng.integers(0, 10**12, 5000)])
    known = {k: i for i, k in enumerate(keys.tolist())}
    assert found.get(asked).tolist() == [known.get(k, -1) for k in asked.tolist()]


def test_segments():
    def cut(how, *texts):
        whole = "".join(texts).encode()
        ends = np.cumsum([len(x.encode()) for x in texts])
        starts, stops = how(np.frombuffer(whole, np.uint8), np.append(0, ends[:-1]), ends)
        return [whole[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]

    assert cut(segments.tiling, "a b\n c  d e", "", " f\ng ", "\t h") == ["a", " b\n c  d", " e", " f", "\ng ", "\t h"]
    assert cut(segments.spaced, "a b\n c  d", "", "e", " \tf ") == ["a", "b", "c", "d", "e", "\tf"]


def test_segments_are_forgotten_and_found_again():
    worked = []

    def work_out(strings):
        worked.extend(strings)
        return [len(x) for x in strings], [1] * len(strings)

    kept = segments.SegmentIds(work_out, segments.spaced, limit=100)
    rng = random.Random(3)
    for _ in range(30):
        texts = [None, "", *(" ".join("x" * rng.randint(1, 90) + rng.choice("abc\0") * rng.randint(0, 3) for _ in range(rng.randint(0, 40))) for _ in range(10))]
        flat, counts = kept.ids_of(pa.array(texts), end=-1)
        assert flat.tolist() == [y for t in texts for y in [*map(len, (t or "").split(" ") if t else []), -1]]
        assert kept.counts_of(pa.array(texts)[2:5]).tolist() == (counts[2:5] - 1).tolist()
    assert len(worked) > len(set(worked))
    # one text with far more distinct segments than are kept at a time
    many = [f"{i:x}" * (1 + 5 * (i % 7 == 0)) for i in range(700_000)]
    flat, counts = kept.ids_of(pa.array(["a b", " ".join(many), "c"]))
    assert counts.tolist() == [2, len(many), 1] and flat[2:-1].tolist() == [len(x) for x in many]
    assert kept.ids_of(pa.array(["abc d"]))[0].tolist() == [3, 1]
    empty = segments.SegmentIds(work_out)
    assert empty.counts_of(pa.array([None, ""], pa.string())).tolist() == [0, 0] and len(empty.ids_of(pa.array([], pa.string()))[1]) == 0


def test_bpe_and_counts_on_rows(docs, rows, nothing, odd):
    library = Tokenizer.from_file(WORDS)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    for r in bpe.encode_digests(docs, WORDS).collect():
        x = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False)))
    for r in token_count.count_tokens(docs, WORDS).collect():
        assert r.n_tokens == len(ids[r.doc_id]) and r.over_limit == (r.n_tokens > 2048)
    encoded = bpe.encode(docs, BYTE)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, BYTE).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows)
    assert token_count.count_tokens(docs.limit(20), P.path("piece_bpe_32k.model")).count() == 20
    for f in (lambda d: bpe.encode_digests(d, WORDS), lambda d: token_count.count_tokens(d, WORDS)):
        assert f(nothing).count() == 0 and f(odd).count() == odd.count()


# --- 3 fingerprints


def test_fingerprints(docs, rows, nothing, odd):
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs).collect()}
    ordered = rows[::-1]
    for k, (i, text, *_) in enumerate(ordered):
        a, b = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        x, y, z = (fingerprints.chunk_sets([t.encode()])[0] for t in (a, edited, b))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(a), sha(edited), fingerprints.written(x), fingerprints.written(y))
        assert r.near_edited == pytest.approx(fingerprints.containment(x, y)) and r.near_next == pytest.approx(fingerprints.containment(x, z))
    assert len(got) == len(rows) and fingerprints.compare_with_next(nothing).count() == 0
    assert fingerprints.compare_with_next(odd).count() == odd.count()
    assert fingerprints.fingerprint(odd).count() == odd.count()


def test_chunks_resist_shifts():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeinorst") for _ in range(7)) for _ in range(2000)).encode()
    a, b, c = fingerprints.chunk_sets([text, b"something before it " + text, text[:5000] + b"an insertion" + text[5000:]])
    assert fingerprints.containment(a, b) > 0.98 and fingerprints.containment(a, c) > 0.98
    assert (fingerprints.read(fingerprints.written(a)) == a).all()
    sizes = a & np.uint64(0xFFFF)
    assert sizes.max() <= fingerprints.MAX and 40 < sizes.mean() < 90


# --- 4 quality


def test_quality(spark, nothing, odd):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(6)) for _ in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(90)) + "." for _ in range(150)]
    bad = [f"{rng.choice(words).upper()}!! " * 60 for _ in range(60)]
    made = [(i, t, "s", "en", 1, "k", 0) for i, t in enumerate(good + bad)]
    df, labels = spark.createDataFrame(made, SCHEMA), spark.createDataFrame([(i, int(i < 150)) for i in range(210)], "doc_id long, quality int")
    model = quality_model.train(df, labels)
    scored = quality_model.score(df, model).select("doc_id", "__score", quality_model.held_out("doc_id").alias("h"), "part").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    held = [r for r in scored if r.h]
    assert sum((r["__score"] >= 0.5) == (r.doc_id < 150) for r in held) / len(held) > 0.97
    assert quality_model.score(odd, model).count() == odd.count() and quality_model.score(nothing, model).count() == 0
    untrained = quality_model.train(df, labels.where("false"))
    assert {r["__score"] for r in quality_model.score(odd, untrained).collect()} == {0.5}


# --- 5 mixing


def test_targets_and_tree():
    assert mixing.targets([100, 100], [1, 3], 3) == [50, 150] and mixing.targets([10, 90], [9, 1], 3) == [30, 70] and mixing.targets([0, 5], [1, 1], 3) == [0, 5]
    tree = mixing.splitting_tree([10, 0, 37], 5, 1)
    assert tree.sum(0).tolist() == [10, 0, 37] and max(tree.sum(1)) - min(tree.sum(1)) <= 1 and (tree >= 0).all()
    assert (tree == mixing.splitting_tree([10, 0, 37], 5, 1)).all()


def test_mixing(spark, docs, rows, nothing, odd):
    settings = {"shard_words": 2000}
    placed = {r.doc_id: r for r in mixing.placed(docs, **settings).collect()}
    sizes, taken, goal = Counter(), Counter(), {}
    for i, text, source, *_ in rows:
        n = len(WORD.findall(text or ""))
        assert placed[i]["__size"] == n and len(placed[i]["__places"]) <= 3
        sizes[source] += n
        taken[source] += n * len(placed[i]["__places"])
        goal[source] = placed[i]["__target"]
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    # s0 is one text of 9,000 words and a few short ones: whole documents can't come nearer from below
    assert all(abs(taken[s] - goal[s]) <= max(10, 0.02 * goal[s]) for s in goal if s != "s0") and taken["s0"] <= goal["s0"], (taken, goal)
    mixed = mixing.mix(docs, **settings)
    assert mixed.count() == sum(len(r["__places"]) for r in placed.values()) and mixed.select("__shard").distinct().count() > 1
    again = {r.doc_id: r["__places"] for r in mixing.placed(docs.repartition(9), **settings).collect()}
    assert all(again[i] == placed[i]["__places"] for i in again)
    assert mixing.mix(nothing).count() == 0 and mixing.placed(odd).count() == odd.count()
    out = shared_dir(spark, "mix")
    mixing.write_mix(docs, out, **settings)
    assert spark.read.parquet(out).count() == mixed.count()


def _mixed_words(spark, made, **settings):
    """By source: target, and words taken; made has (doc_id, number of words, source)."""
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, n, s in made], "doc_id long, text string, source string").repartition(3)
    goal, taken = {}, Counter()
    for r in mixing.placed(df, **settings).collect():
        assert len(r["__places"]) <= 3 and len({p.shard for p in r["__places"]} - set(range(1000))) == 0
        goal[r.source] = r["__target"]
        taken[r.source] += r["__size"] * len(r["__places"])
    return goal, taken


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("share", [0.45, 0.55])
def test_mixing_goes_on_behind_a_long_document(spark, seed, share):
    made = [(i, 50, "a") for i in range(1000)] + [(5000, 50_000, "a")] + [(6000 + i, 100, "b") for i in range(1000)]
    # a's target is the share of its 100,000 words
    goal, taken = _mixed_words(spark, made, weights=(share, 2 - share), seed=seed)
    assert goal["a"] == pytest.approx(share * 100_000)
    assert all(0 <= goal[s] - taken[s] <= 100 for s in goal), (goal, taken)


def test_mixing_takes_a_source_whose_rest_is_its_size(spark):
    goal, taken = _mixed_words(spark, [(i, 1, "a") for i in range(100)] + [(200 + i, 1, "b") for i in range(199)], weights=(1.0, 2.0))
    assert goal["a"] == pytest.approx(99.67, abs=0.01) and taken == {"a": 100, "b": 199}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_counts_all_copies_of_a_row(spark, seed):
    made = [(i, 7 + i % 13, "a") for i in range(60) for _ in range(5)] + [(None, 3, "a")] * 90 + [(100 + i, 1 + i % 50, "b") for i in range(200)]
    goal, taken = _mixed_words(spark, made, weights=(2.0, 3.0), seed=seed)
    # the least group of copies has 35 words
    assert all(-1 <= goal[s] - taken[s] <= 35 for s in goal), (goal, taken)


# --- 6 chat


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "<|", "<\\\\|x<|", "", "plain é\n", "<|endoftext|>"]
    made = [(c, t, r, x, 5) for c in range(3) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "assistant", None, "user", "assistant"], nasty, strict=True))]
    made += [(7, 0, "assistant", None, 1), (None, None, "user", "q", 1), (9, 0, "user", "same", 1), (9, 0, "user", "same", 1)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, n int").repartition(4)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, BYTE), BYTE).collect()}
    turns = defaultdict(list)
    for c, _, r, x, _ in made:
        turns[c].append((r or "", x or ""))
    assert set(got) == set(turns)
    for c, pairs in turns.items():
        loss = "".join(x for r, x in pairs if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(pairs), sha("".join(f"{r}\n{x}\n" for r, x in pairs)), len(loss), sha(loss))
    for x in nasty:
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)
    assert chat.format_conversations(df.where("false"), BYTE).count() == 0


# --- 7 secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(spark, docs, rows, nothing, odd):
    more = ["ghp_" + "a1" * 20 + " é token='xyz123456'", "-----BEGIN RSA PRIVATE KEY-----", "https://me:pa55word@host/x", "API_KEY = \"k.e-y=12/3\"; apikey:short", "AKIA1 AKIA" + "Q" * 16, "tokenTOKEN:abcdefgh"]
    made = [(i, t) for i, t, *_ in rows] + [(9000 + i, t) for i, t in enumerate(more)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    report = {r.doc_id: r for r in secret_scan.report(secret_scan.scan(df)).collect()}
    names = ("assign", "access", "hex")
    for i, text in made:
        spans = _base(text or "")
        r = report[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert r.base_sha256 == sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans))
    kinds = {s.split(":")[0] for r in report.values() for s in r.spans.split(",") if s}
    assert {"github", "private_key", "url_login"} <= kinds
    redacted = {r.doc_id: r.t for r in secret_scan.scan(df).select("doc_id", secret_scan.redacted().alias("t")).collect()}
    assert all(not _base(redacted[i] or "") for i, _ in made) and redacted[0] is None
    assert secret_scan.scan(nothing).count() == 0 and secret_scan.scan(odd).count() == odd.count()
    plan = secret_scan.report(secret_scan.scan(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z]+") == {frozenset({"aki", "kia"})} and frozenset() in secret_scan.trigram_query("[0-9a-f]{24,}")
    assert secret_scan.trigram_query("(abc|xyz)+q?") == {frozenset({"abc"}), frozenset({"xyz"})}
    rng = random.Random(5)
    for rule in secret_scan.RULES:
        clauses = secret_scan.trigram_query(rule.pattern)
        for text in ("password = abcdefg", "AKIA" + "A" * 30, "gho_" + "b" * 40, "xoxb-" + "1" * 12, "sk_live_" + "q" * 20, "http://a:bcd@", "-----BEGIN EC PRIVATE KEY-----", "".join(rng.choice("0123456789abcdef") for _ in range(30))):
            for m in re.finditer(rule.pattern, text):
                assert any(all(t in m[0].lower() for t in c) for c in clauses), (rule.kind, text)


# --- 9 near-duplicates


def _components(made, k):
    sets = {}
    for i, text in made:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(5)) for _ in range(500)]
    texts = [None, "", "  ", "One", "one", "one two", "ONE  two\n", "one two three"]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    made = list(enumerate(texts))
    rng.shuffle(made)
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(4), k).collect()}
    for i, (n, c) in _components(made, k).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i), i


def test_near_duplicates_odd_rows(nothing, odd):
    assert near_dup.near_duplicates(nothing).count() == 0
    found = near_dup.near_duplicates(odd)
    assert found.count() == odd.count() and found.where("kept is null").count() == 0


def test_near_duplicates_of_many_unlike_slots(spark):
    """A pair over the threshold whose 2-bit signatures differ in more than 24 slots, the full ones in fewer than 32."""
    words = [f"w{i}" for i in range(300)]
    sig = lambda w: near_dup.signatures(near_dup.shingle_sets([" ".join(w).encode()], 1))[0]
    low = lambda x: (x & np.uint64(3)).astype(int)
    whole, left = sig(words), list(words)
    while (low(sig(left)) != low(whole)).sum() <= 24:
        without = {x: sig([y for y in left if y != x]) for x in left}
        left.remove(max(left, key=lambda x: 3 * (low(without[x]) != low(whole)).sum() - 2 * (without[x] != whole).sum()))
    assert len(left) >= 0.8 * len(words) and int((sig(left) != whole).sum()) < 32
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(left))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 1).collect()} == {1: 1, 2: 1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[300] == 100


# --- 10 quality rules


def test_suffix_repeats():
    rng = random.Random(3)
    for _ in range(150):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 5))]
        starts = np.append(0, np.cumsum([len(x) for x in texts]))
        expected = []
        for w in texts:
            for i in range(len(w)):
                best = 0
                for j in range(len(w)):
                    n = 0
                    while i != j and i + n < len(w) and j + n < len(w) and w[i + n] == w[j + n]:
                        n += 1
                    best = max(best, n)
                expected.append(best if best >= 5 else 0)
        assert repetition.repeats(np.array([y for x in texts for y in x], np.int64), starts).tolist() == expected


def test_quality_rules(docs, rows, nothing, odd):
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    for i, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = [False] * len(w)
        for k in range(len(w) - 4):
            if windows[tuple(w[k : k + 5])] > 1:
                covered[k : k + 5] = [True] * 5
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(covered))
        assert r.base_failed == (len(w) < 10 or 100 * sum(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert repetition.quality_rules(nothing).count() == 0 and repetition.quality_rules(odd).count() == odd.count()


# --- the pipeline


def test_pipeline(spark, odd):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = []
    from tamarack.runtime import materialize

    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), "stage")
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2] and counts[3] == counts[4] and docs.columns == ["doc_id", "ids"]
    shaped = odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, shaped, data).count()
        stage(spark, shaped.where("false"), data).count()


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdeinorst") for _ in range(6)) for _ in range(60)) for _ in range(5))
    made = [(3, a), (7, a), (7, b), (5, c), (5, d), (5, c), (11, e), (11, e.upper()), (12, e + " more"), (2, d), (None, a), (None, None), (14, None), (14, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = Counter((r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    kept = got - Counter({(12, e + " more"): 1})
    assert (12, e + " more") in got or (11, e) in kept
    assert kept - Counter({(11, e): 1}) == Counter([(3, a), (7, b), (5, c), (2, d), (None, a), (None, ""), (14, ""), (14, "")])
    assert got[11, e] + got[12, e + " more"] == 1
